"""Files by byte ranges: prefixes and framed lines, against plain reading."""

import io
import random
import resource

import pytest

from vigilake.sources import files


def plain(data, most):
    """Offset, line and error by plain splitting."""
    out, at = [], 0
    parts = data.split(b"\n")
    for i, raw in enumerate(parts):
        if raw or i < len(parts) - 1:
            line = raw[:-1] if raw.endswith(b"\r") and len(raw) <= most + 1 else raw
            if len(line) > most:
                out.append((at, None, "line too long"))
            else:
                try:
                    out.append((at, line.decode(), None))
                except UnicodeDecodeError:
                    out.append((at, None, "no UTF-8"))
        at += len(raw) + 1
    return out


def random_lines(rng, n):
    return b"".join(rng.choice([b"", b"a", b"\xc3\xa9", b"\r", b"\xff", b"x" * 8, b"y" * 9, b"z" * 10 + b"\r", b"w" * 40]) * rng.randrange(2) + rng.choice([b"\n", b"\r\n", b"", b"\n\n"]) for _ in range(n))


def test_ranges_cover_every_line_once(monkeypatch):
    rng = random.Random(1)
    for chunk in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(files, "CHUNK", chunk)
        for _ in range(60):
            data = random_lines(rng, 40)
            for size in (1, 2, 5, 11, 64, 10_000):
                got = [x for a in range(0, len(data), size) for x in files.framed(io.BytesIO(data), a, a + size, 10)]
                want = plain(data, 10)
                assert [o for o, _ in got] == [o for o, *_ in want]
                assert [x is None for _, x in got] == [e == "line too long" for *_, e in want]
                assert [x.decode() for _, x in got if x is not None and b"\xff" not in x] == [x for _, x, _ in want if x is not None]


def test_lines_as_a_source(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for name in ("a.log", "b.log", "_hidden", "c.txt"):
        data = random_lines(rng, 300)
        (tmp_path / name).write_bytes(data)
        if name.endswith(".log"):
            want += [(name, *r) for r in plain(data, 10)]
    (tmp_path / "empty.log").write_bytes(b"")
    for size in (50, 10_000):
        got = files.lines(spark, f"{tmp_path}/*.log", 10, size).collect()
        assert sorted((r.file.rsplit("/", 1)[1], r.offset, r.line, r.error) for r in got) == sorted(want)
    assert files.lines(spark, str(tmp_path), 10).count() == len(want) + len(plain((tmp_path / "c.txt").read_bytes(), 10))
    assert files.lines(spark, f"file://{tmp_path}/none*").count() == 0
    with pytest.raises(Exception, match="none"):
        files.lines(spark, f"{tmp_path}/none/x").count()


def test_prefixes(spark, tmp_path):
    texts = {"a": b"", "b": b"abcdef", "c": "ééé".encode(), "d": b"ab\xffcd", "e": "a\U0001f600b".encode(), "f": b"abcde"}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[1]: (r.text, r.cut) for r in files.prefixes(spark, str(tmp_path), 5).collect()}
    assert got == {"a": ("", False), "b": ("abcde", True), "c": ("éé", True), "d": ("ab�cd", False), "e": ("a\U0001f600", True), "f": ("abcde", False)}


def test_a_file_of_three_gigabytes_in_a_small_worker(spark, tmp_path):
    """Its prefix, and its lines, of which one is all of it but a few bytes."""
    big = tmp_path / "big"
    with big.open("wb") as f:
        f.write(b"first\n")
        f.truncate(3 << 30)
        f.seek(3 << 30)
        f.write(b"\nlast\n")
    row = files.prefixes(spark, str(big)).first()
    assert len(row.text) == 1 << 20 and row.text.startswith("first\n\x00") and row.cut
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with big.open("rb") as f:
        got = list(files.framed(f, 0, 3 << 31, 1 << 24))
    assert got == [(0, b"first"), (6, None), ((3 << 30) + 1, b"last")]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # kB
