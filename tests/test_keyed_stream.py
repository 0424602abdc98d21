import os
import random

from quirewise.streaming import ingest as stream


def test_keys_are_remembered_as_digests(spark, tmp_path):
    rnd = random.Random(5)
    texts = ["".join(chr(rnd.randrange(33, 0x2FF)) for _ in range(10_000)) for _ in range(60)]
    batches = [
        [(i, texts[i % 40], "a") for i in range(60)] + [(900, None, "a"), (901, "x", None), (902, texts[3], "b")],
        [(i, texts[i % 60], "a") for i in range(100, 160)] + [(99, texts[50], "a"), (100, texts[50], "a")],
    ]
    source, target, refused, progress = (str(tmp_path / n) for n in ("in", "stored", "refused", "progress"))
    seen, want = set(), []
    for rows in batches:
        df = spark.createDataFrame(rows, "doc_id int, text string, kind string")
        df.coalesce(1).write.mode("append").parquet(source)
        stream.ingest_keyed(stream.table_stream(spark, source, df.schema), target, refused, progress, ["text", "kind"], ["doc_id"])
        known = set(seen)
        for doc, text, kind in sorted(rows, key=lambda r: r[0]):
            key = (text, kind)
            error = "missing key" if None in key else "key already stored" if key in known else "key repeated in this batch" if key in seen else None
            seen.add(key)
            want.append((doc, error))
    got = [(r["doc_id"], None) for r in spark.read.parquet(target).collect()]
    got += [(r["doc_id"], r["error"]) for r in spark.read.parquet(refused).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    state = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{progress}/state") for f in files)
    assert 0 < state < 200_000  # sixty texts of 10,000 characters
