"""Stateless operators applied to a stream (memory sink, synchronous)."""

import os
import tempfile
from datetime import datetime

from conftest import SF0001
from sentinela import constants as K
from sentinela.operators.clean import clean_and_validate
from sentinela.operators.derive import derive_time_features
from sentinela.plans import fixtures as X
from sentinela.streaming.incremental import clean_derive_stream, read_stream


def test_stream_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="sentinela-stream-")
    occ = X.occ(spark, SF0001)
    occ.repartition(3).write.mode("overwrite").parquet(os.path.join(d, "in"))
    as_of = datetime(2024, 12, 31)
    sdf = read_stream(spark, os.path.join(d, "in"), occ.schema, max_files_per_trigger=1)
    q = (clean_derive_stream(sdf, as_of).writeStream.format("memory").queryName("sentinela_stream_out")
         .option("checkpointLocation", os.path.join(d, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(r[0] for r in spark.sql("SELECT occurrence_id FROM sentinela_stream_out").collect())
    want = sorted(r[0] for r in derive_time_features(clean_and_validate(occ, as_of=as_of)).select(K.ID).collect())
    assert got == want and len(got) > 0


def test_stream_dedupes_within_watermark(spark):
    d = tempfile.mkdtemp(prefix="sentinela-stream-dup-")
    occ = X.occ(spark, SF0001)
    occ.coalesce(1).write.mode("overwrite").parquet(os.path.join(d, "in", "a"))
    occ.coalesce(1).write.mode("overwrite").parquet(os.path.join(d, "in", "b"))   # the same rows again
    sdf = (spark.readStream.schema(occ.schema).option("recursiveFileLookup", "true")
           .option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "in")))
    as_of = datetime(2024, 12, 31)
    q = (clean_derive_stream(sdf, as_of, watermark="3650 days").writeStream.format("memory")
         .queryName("sentinela_stream_dedupe").option("checkpointLocation", os.path.join(d, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = [r[0] for r in spark.sql("SELECT occurrence_id FROM sentinela_stream_dedupe").collect()]
    want = derive_time_features(clean_and_validate(occ, as_of=as_of)).count()
    assert len(got) == len(set(got)) == want
