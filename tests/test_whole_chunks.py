"""Long documents and long lines are in chunks from end to end."""

from corpuscle.plans.index import build_index


def test_no_text_is_cut(spark):
    long_line = "".join(f"w{k} " for k in range(30_000))
    wide_line = "\u00e9\u4e2d\U0001f600" * 20_000
    texts = {
        "one.txt": long_line, "wide.txt": f"first\n{wide_line}\nlast", "big.txt": "some words here\n" * 40_000,
        "a.ts": f"const x = 1\n{long_line}\nconst y = 2", "req/package.json": '{"a": 1}\n' * 5_000, "short.md": "# t\nbody",
    }
    rows = [("r", "s", p, len(t.encode()), t.encode()) for p, t in texts.items()]
    files = spark.createDataFrame(rows, "repo string, snapshot_id string, path string, size_bytes long, content binary")
    index = build_index(files)
    chunks = index.chunks.select("path", "start_line", "end_line", "part", "text", "truncated", "tokens", "chunk_id").collect()
    assert not any(r.truncated for r in chunks) and all(r.tokens <= 4_000 for r in chunks)
    assert len({r.chunk_id for r in chunks}) == len(chunks)
    assert index.files.where("skip_reason IS NOT NULL").count() == 0
    for path, piece in (("one.txt", long_line), ("wide.txt", wide_line), ("a.ts", long_line)):
        found = sorted((r for r in chunks if r.path == path), key=lambda r: (r.start_line, r.part))
        assert piece.strip() in "".join(r.text.split("\n", 1)[1] for r in found).replace("\n", "")
    for path in ("big.txt", "req/package.json"):
        covered = {n for r in chunks if r.path == path for n in range(r.start_line, r.end_line + 1)}
        assert covered >= set(range(1, texts[path].count("\n") + 1))
