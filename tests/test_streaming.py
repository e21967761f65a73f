import json

from rscframe.operators import health
from rscframe.settings import CrawlConfig
from rscframe.streaming import crawl


def run(spark, tmp_path, df, make, schema):
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql("SELECT * FROM out").collect()


def test_throttle_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([("a", i, 5, (0.2 if 5 < i < 15 else 0.9)) for i in range(30)], "domain string, seq long, n_chunks int, score double")
    got = run(spark, tmp_path, log, lambda s: crawl.throttle_steps(s, window=4), log.schema)
    want = health.throttled(log, window=4).where("step is not null").collect()
    assert sorted((r.domain, r.seq, r.step) for r in got) == sorted((r.domain, r.seq, r.step) for r in want) and want


def test_drift_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([("a", i, 5, (0.1 if i in (8, 20) else 0.9)) for i in range(30)], "domain string, seq long, n_chunks int, score double")
    got = run(spark, tmp_path, log, crawl.drift_signals, log.schema)
    assert sorted(r.seq for r in got) == sorted(r.seq for r in health.drifted(log).collect()) == [8, 20]


def test_fragments_may_cut_characters(spark, tmp_path):
    html = f"<html><script>self.__next_f.push([1,{json.dumps('0:{\"a\":\"é\"}', ensure_ascii=False)}])</script></html>".encode()
    parts = spark.createDataFrame([(1, i, html[i * 7 : i * 7 + 7]) for i in range(len(html) // 7 + 1)], "page_id long, frag_idx int, bytes binary")
    got = run(spark, tmp_path, parts, crawl.rows_as_they_arrive, parts.schema)
    assert [(r.chunk_key, json.loads(r.value_json)) for r in got] == [("0", {"a": "é"})]


def test_early_stop_finds_nested_objects_and_drops_the_rest(spark, tmp_path):
    rows = ['0:{"a":{"deep":[{"k":1,"v":2}]}}\n', '1:{"k":3,"v":4}\n', '2:{"z":1}\n']
    parts = spark.createDataFrame([(1, i, r.encode()) for i, r in enumerate(rows)], "page_id long, frag_idx int, bytes binary")
    got = run(spark, tmp_path, parts, lambda s: crawl.rows_as_they_arrive(s, config=CrawlConfig(stream_keys=("k", "v"), stream_check_interval=1)), parts.schema)
    assert [json.loads(r.value_json) for r in got if r.is_match] == [{"k": 1, "v": 2}]


def test_a_page_is_read_at_intervals_and_up_to_its_limit():
    b = crawl.Buffer()
    b.feed("0:[1]\né".encode()[:-1], 100, "utf-8")
    assert not b.due(100, 100) and b.due(3, 100) and b.text == "0:[1]\n"
    b.feed("é".encode()[1:] + b"x" * 200, 20, "utf-8")
    assert b.size == 20 and b.text.startswith("0:[1]\né") and b.due(100, 20)


def test_items_that_are_no_objects_pass(spark, tmp_path):
    from rscframe.operators import search

    items = spark.createDataFrame([(i, t) for i, t in enumerate(['{"a":1,"b":2}', '{"b":2,"a":1}', "5", "5", "[1]", "no json", None, '{"a":2}'])], "seq long, item_json string")
    batch = sorted(r.seq for r in search.crawl_deduped(items, "seq").collect())
    stream = sorted(r.seq for r in run(spark, tmp_path, items, crawl.unseen_items, items.schema))
    assert batch == [0, 2, 3, 4, 5, 6, 7] and len(stream) == 7 and stream[1:] == batch[1:]


def test_signals_reach_handlers(spark, tmp_path):
    log = spark.createDataFrame([("a", i, 5, (0.1 if i == 8 else 0.9)) for i in range(12)], "domain string, seq long, n_chunks int, score double")
    log.write.parquet(str(tmp_path / "in"))
    got: list = []
    signals = crawl.drift_signals(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")))
    q = crawl.on_signal(signals, lambda **s: got.append(s), checkpointLocation=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert [(s["domain"], s["seq"]) for s in got] == [("a", 8)]


def test_watched_pages(spark, tmp_path):
    rows = [(1, 0, '0:{"a":[1,{"b":2}]}'), (1, 1, '0:{"a":[1,{"b":3}],"c":1}')]
    got = run(spark, tmp_path, spark.createDataFrame(rows, "page_id long, seq long, html string"), crawl.watched, "page_id long, seq long, html string")
    assert sorted((r.seq, r.path, r.change) for r in got) == [(1, "0.a.1.b", "changed"), (1, "0.c", "added")]


def test_windows_in_blocks_equal_those_of_whole_domains(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(d, i * i, rng.choice([0, 5, 5]), rng.randrange(64) / 64) for d in ("a", "b", None) for i in range(60)]
    log = spark.createDataFrame(rows, "domain string, seq long, n_chunks int, score double")

    def all_():
        return [sorted(map(str, x.collect())) for x in (health.throttled(log, 6, 0.5), health.running_confidence(log), health.drifted(log))]

    whole = all_()
    monkeypatch.setattr(health, "BLOCK", 7)
    assert all_() == whole and len(whole[0]) > 100
