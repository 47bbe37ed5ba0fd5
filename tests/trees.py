"""Family files for the tests."""


def person(ref, place=None, date=None, coords=None, famc=None, name=None):
    out = [f"0 @{ref}@ INDI"] + ([f"1 NAME {name}"] if name else [])
    if place is not None or date or coords:
        out += ["1 BIRT"] + ([f"2 DATE {date}"] if date else []) + ([f"2 PLAC {place}"] if place is not None else [])
        out += ["3 MAP", f"4 LATI {coords[0]}", f"4 LONG {coords[1]}"] if coords else []
    return out + ([f"1 FAMC @{famc}@"] if famc else [])


def family(ref, husband=None, wife=None, children=()):
    return [f"0 @{ref}@ FAM"] + ([f"1 HUSB @{husband}@"] if husband else []) + ([f"1 WIFE @{wife}@"] if wife else []) + [f"1 CHIL @{c}@" for c in children]


def text(*records):
    return "\n".join(["0 HEAD", *(line for r in records for line in r), "0 TRLR", ""])


# Thirteen people in seven families: two lines meet in I10, I5 has no father, I11's place is unknown.
BORN = {
    "I1": ("Albany, Oregon, USA", "1998"), "I2": ("Portland, Oregon, USA", "1970"), "I3": ("Boise, Idaho, USA", "1971"),
    "I4": ("Salt Lake City, Utah, USA", "1945"), "I5": ("Christiania, Norway", "1947"), "I6": ("Åbo, Finland", "1944"),
    "I7": ("Lemberg, Austria", "1948"), "I10": ("Köln, Germany", "1915"), "I11": ("Hinterland", "ABT 1918"), "I12": ("Bergen, Norway", "1920"),
    "I13": ("Stockholm, Sweden", "1916"), "I14": ("Helsinki, Finland", "1930"), "I15": ("Pressburg, Hungary", "1895"),
}
PARENTS = {"I1": ("I2", "I3"), "I2": ("I4", "I5"), "I3": ("I6", "I7"), "I4": ("I10", "I11"), "I5": (None, "I12"), "I6": ("I13", "I14"), "I7": ("I10", "I15")}
SAMPLE = text(
    *[person(i, place, date, famc=f"F{i}" if i in PARENTS else None, name=f"P{i} /Line/") for i, (place, date) in BORN.items()],
    *[family(f"F{c}", f, m, [c]) for c, (f, m) in PARENTS.items()],
)
