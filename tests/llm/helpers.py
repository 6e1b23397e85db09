"""Fixtures and plain versions that the operators are held against."""

import re

UP = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FRENCH = "le chat de la maison et les enfants sont dans le jardin avec une rose. "
ENGLISH = "the house of the old man was near the river and they went there with him. "
GERMAN = "der alte mann und die frau gehen mit dem hund durch den wald nach hause. "


def lower(text):
    return (text or "").encode().translate(UP)


def spaced(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(text))


def shingle_set(text, n=5):
    w = spaced(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def odd_rows():
    """doc_id, text, lang, source, and columns whose names operators use inside."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word7 ", "other ")
    long = " ".join(f"tok{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", None), (4, None, "en", "a"), (5, "", None, "b"), (6, "   \n\t ", "de", "b"), (7, "one", "de", "b"), (8, "one", "de", "c"),
        (9, "1234 5678 !!!", None, None), (10, long, "en", "a"), (11, long + " end", "en", "a"), (None, "text without an id, the only one of it", "en", "c"), (12, ENGLISH * 6, "en", "d"), (13, FRENCH * 6, "fr", "d"),
        (14, GERMAN * 6, "de", "d"), (15, ENGLISH * 6, "en", "d"), (15, ENGLISH * 6, "en", "d"), (16, "é" * 300 + "\n" + "é" * 300, "fr", "e"), (17, "a" * 500, None, "e"), (18, base.upper(), "en", "é"),
    ]
    return [(*r, "x", 1, "y", 2.0, "z") for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, size string, n int, key string, score double, kind string"


def write(spark, path, rows, schema=SCHEMA, name="documents"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def components(vertices, links):
    parent = {v: v for v in vertices}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in vertices}
