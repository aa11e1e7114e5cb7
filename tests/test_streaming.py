import json

from skein.streaming.ingest import running_counts, stream_events


def test_counts_follow_new_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()

    def add(name, *roles):
        lines = [json.dumps({"type": "response_item", "timestamp": f"t{k}", "payload": {"type": "message", "role": r, "content": "x"}}) for k, r in enumerate(roles)]
        (logs / name).write_text("\n".join([*lines, "bad {"]))

    add("a.jsonl", "user", "assistant")
    query = running_counts(stream_events(spark, str(logs))).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        add("b.jsonl", "user", "user", "system")
        query.processAllAvailable()
        got = {r.path.rsplit("/", 1)[1]: (r.user_messages, r.assistant_messages, r.latest) for r in spark.table("counts").collect()}
    finally:
        query.stop()
    assert got == {"a.jsonl": (1, 1, "t1"), "b.jsonl": (2, 0, "t2")}
