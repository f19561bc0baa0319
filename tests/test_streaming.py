from terrapanel.sources.store import PartStore
from terrapanel.streaming.landing import merge_arrivals, mirror_arrivals


def test_arrivals_are_mirrored_and_merged_once(spark, tmp_path):
    inbox, mirror, table = (tmp_path / n for n in ("in", "mirror", "table"))
    inbox.mkdir()
    (inbox / "a.csv").write_text("k,v\na,1\nb,1\n")
    run = lambda: (mirror_arrivals(spark, str(inbox), "k string, v int", str(mirror), str(tmp_path / "c1")).awaitTermination(), merge_arrivals(spark, str(mirror), str(table), str(tmp_path / "c2"), ["k"], "v").awaitTermination())
    run()
    (inbox / "b.csv").write_text("k,v\nb,2\nc,3\n")
    run()
    run()
    assert spark.read.parquet(str(mirror)).count() == 4
    assert sorted((r["k"], r["v"]) for r in PartStore(spark, str(table)).read().collect()) == [("a", 1), ("b", 2), ("c", 3)]
