"""The keyword dictionary the news queries run with, over words of the document table."""

ENTRIES = [
    ("R0", "AFRICA", ["thanedble", "ertion", "onbleea", "reedes", "thndly", "inging"]),
    ("R1", "AMERICA", ["oument", "queque", "laleenéelle", "enmentai", "réleou"]),
    ("R2", "ASIA", ["enlich", "erkeit", "einlich", "erüver", "schung", "nicht"]),
    ("R3", "EUROPE", ["ciónga", "ciónado", "asción", "ñmente", "osezue"]),
    ("R4", "MIDDLE EAST", ["tionnt", "ntreou", "thrent", "eaueau", "einver", "ertion", "nicht"]),
]

KEYWORD_SQL = "kw(l1_code, l1_name, pos, keyword, n_keywords) as (values " + ", ".join(
    f"('{c}', '{n}', {p}, '{k}', {len(ks)})" for c, n, ks in ENTRIES for p, k in enumerate(ks)
) + ")"
