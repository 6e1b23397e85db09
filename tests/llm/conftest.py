import pytest

from tests.llm import helpers as H


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with odd documents, a benchmark, and pages and embeddings with odd rows."""
    at = str(tmp_path_factory.mktemp("odd"))
    H.write(spark, at, H.odd_rows())
    H.write(spark, at, [(1, " ".join(f"word{i}" for i in range(3, 20))), (2, "one"), (3, None), (4, "!!!"), (None, "tok5x5 tok6x6 tok7x7"), (1, "one"), (5, "old man was near the river and they went there with him")], "item_id long, text string", "benchmark")
    H.write(spark, at, [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x?q#f"), (4, "https://example.org/en/123/"), (4, "https://example.org/en/123/"), (5, "http://org/"), (6, "http://org"), (7, "http://x.com/fr/"), (8, "http://x.com/de/" + "p" * 50_000), (9, "http://x.net?a://b/"), (None, "http://borg/x")], "page_id long, url string", "pages")
    vec = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(8)]) for i in range(100)]
    vec += [(100, None), (101, [0.0] * 8), (102, [1.0] * 7), (103, [float("nan")] * 8), (104, [None] + [1.0] * 7), (None, [1.0] * 8), (105, [3.0] * 8), (106, [3.0] * 8), (106, [3.0] * 8), (120, [3.0] * 8)]
    H.write(spark, at, vec, "vec_id long, embedding array<float>", "embeddings")
    H.write(spark, at, [(1, 1, 0, "x"), (3, 0, 1, "y"), (3, 1, 1, "y"), (None, 1, 1, "z"), (12, None, 1, "z")], "doc_id long, quality int, toxic int, mask string", "labels")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    H.write(spark, at, [])
    H.write(spark, at, [], "item_id long, text string", "benchmark")
    H.write(spark, at, [], "page_id long, url string", "pages")
    H.write(spark, at, [], "vec_id long, embedding array<float>", "embeddings")
    H.write(spark, at, [], "doc_id long, quality int, toxic int", "labels")
    return at
