from loomery.operators import taxonomy
from loomery.sources import tabular


def test_preferred_names(spark):
    rows = [(1, "x", "synonym", 0), (1, "y", "scientific name", 1), (2, "b", "synonym", 3), (2, "a", "common name", 2), (3, "q", "scientific name", 5), (3, "p", "scientific name", 4)]
    got = taxonomy.preferred_names(spark.createDataFrame(rows, "id int, name string, name_class string, at int"))
    assert {tuple(r) for r in got.collect()} == {(1, "y"), (2, "a"), (3, "p")}


def test_sample_from_path(spark, tmp_path):
    for name in ("s1.stats.txt", "s2.stats.txt"):
        (tmp_path / name).write_text(f"{name}\n")
    got = tabular.with_sample(spark.read.text(str(tmp_path)))
    assert {tuple(r) for r in got.collect()} == {("s1.stats.txt", "s1"), ("s2.stats.txt", "s2")}
