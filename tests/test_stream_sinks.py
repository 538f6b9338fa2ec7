"""A micro-batch keeps no enriched row, and both sinks hold what the batch plan gives."""

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from apsight.operators import geocode
from apsight.plans import catalog
from apsight.sources.fixtures import Fixtures
from apsight.streaming.enrich_stream import start_enrichment_stream
from paths import SF_SMALL


def test_sinks_without_kept_rows(spark, tmp_path, monkeypatch):
    fx = Fixtures(spark, SF_SMALL)
    raw = str(tmp_path / "raw")
    catalog.raw_text(fx).write.option("sep", "\t").csv(raw)
    kept = []
    persist = ClassicFrame.persist
    monkeypatch.setattr(ClassicFrame, "persist", lambda self, *a, **kw: kept.append(self.columns) or persist(self, *a, **kw))
    q = start_enrichment_stream(spark, raw, fx.oui, fx.geocode_responses, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination()
    assert q.exception() is None
    assert kept and not [c for c in kept if "raw_bssid" in c]   # the whole enriched batch before
    tagged = catalog.tagged(fx)
    for name, want in (("integrated", geocode.integrated_rows(tagged)), ("dead_letter", geocode.dead_letter_rows(tagged))):
        got = spark.read.parquet(str(tmp_path / "out" / name)).drop("batch_id")
        assert got.columns == want.columns and got.count() == want.count() > 0
        same = lambda d: d.select(F.xxhash64(*[F.col(c).cast("string") for c in d.columns]).alias("h")).groupBy("h").count()
        assert same(got).exceptAll(same(want)).count() == 0
