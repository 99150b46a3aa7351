import json

from tonequarry.streaming import ingest


def test_ingest_in_two_runs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("accession", "cik", "status", "size", "completed_at"), r, strict=True))) for r in rows))

    def run():
        ingest.store(ingest.arrivals(spark, str(folder)), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
        return {r.accession: (r.status, r.size) for r in ingest.state(spark, str(tmp_path / "log")).collect()}

    put("a.json", ("1", 1, "failed", 0, "2024-01-01T00:00:00Z"), ("2", 2, "ok", 5, "2024-01-01T00:00:00Z"), ("2", 2, "ok", 5, "2024-01-01T00:00:00Z"))
    assert run() == {"1": ("failed", 0), "2": ("ok", 5)}
    put("b.json", ("1", 1, "ok", 7, "2024-01-01T12:00:00Z"))
    assert run() == {"1": ("ok", 7), "2": ("ok", 5)}
