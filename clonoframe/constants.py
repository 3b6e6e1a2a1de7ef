"""Ambiguity codes, regions, amino-acid scales, the genetic code, abbreviations and colours."""

from itertools import product

# Readings of ambiguous bases and residues, regions of the standard numbering, scales of residues.
IUPAC_DNA = {
    "A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT",
    "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT",
}
IUPAC_AA = {**{c: c for c in "ACDEFGHIKLMNPQRSTVWY*"}, "B": "NR", "J": "IL", "Z": "EQ", "X": "ABCDEFGHIJKLMNPQRSTVWXYZ*"}
IMGT_REGIONS = {"fwr1": (1, 78), "cdr1": (79, 114), "fwr2": (115, 165), "cdr2": (166, 195), "fwr3": (196, 312)}
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
BULKINESS = {
    "A": 11.50, "R": 14.28, "N": 12.82, "D": 11.68, "C": 13.46, "Q": 14.45, "E": 13.57, "G": 3.40, "H": 13.69, "I": 21.40,
    "L": 21.40, "K": 15.71, "M": 16.25, "F": 19.80, "P": 17.43, "S": 9.47, "T": 15.77, "W": 21.67, "Y": 18.03, "V": 21.57,
}
POLARITY = {
    "A": 8.1, "R": 10.5, "N": 11.6, "D": 13.0, "C": 5.5, "Q": 10.5, "E": 12.3, "G": 9.0, "H": 10.4, "I": 5.2,
    "L": 4.9, "K": 11.3, "M": 5.7, "F": 5.2, "P": 8.0, "S": 9.2, "T": 8.6, "W": 5.4, "Y": 6.2, "V": 5.9,
}
PK = {"C": 8.5, "D": 3.9, "E": 4.1, "H": 6.5, "K": 10.8, "R": 12.5, "Y": 10.1}
# The standard genetic code in the order T, C, A, G of each place.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), GENETIC_CODE, strict=True)}


def codon(c: str) -> str:
    """The residue of a codon; of an ambiguous one, that of all its readings if they agree; X otherwise."""
    if any(b not in IUPAC_DNA for b in c):
        return "X"
    found = {CODONS["".join(x)] for x in product(*(IUPAC_DNA[b] for b in c))}
    return found.pop() if len(found) == 1 else "X"


#: The ambiguous base of each set of bases.
DNA_IUPAC = {bases: code for code, bases in IUPAC_DNA.items()}
# Three-letter names, and the colours of bases and chains.
ABBREV_AA = {
    "A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile",
    "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val",
}
DNA_COLORS = {"A": "#64F73F", "C": "#FFB340", "G": "#EB413C", "T": "#3C88EE"}
IG_COLORS = {"IGHA": "#377EB8", "IGHD": "#FF7F00", "IGHE": "#E41A1C", "IGHG": "#4DAF4A", "IGHM": "#984EA3", "IGHK": "#E5C494", "IGHL": "#FFD92F"}
TR_COLORS = {"TRA": "#CBD5E8", "TRB": "#F4CAE4", "TRD": "#FDCDAC", "TRG": "#E6F5C9"}
