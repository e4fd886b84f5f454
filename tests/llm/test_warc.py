import glob
import hashlib
import random

import pytest
import zstandard

from plumbline.llm import op01_warc as m


def brute(rows, least=1000):
    last = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page_id is not None:
            last[data] = max(last.get(data, page_id), page_id)
    out = []
    for page_id, url, html in rows:
        data = (html or "").encode()
        other = last.get(data)
        refers = other if other is not None and other != page_id else None
        out.append((page_id, None if url is None else m.uri(url), len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", refers, data if refers is None else None))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(1)
    words = ["<p>", "</p>", "page", "é", "text", "\n", "\r\n\r\n"]
    page = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, f"http://a.example/{i}?q=é b\r\nX: 1%20", page(rng.randrange(0, 900))) for i in range(120)]
    same = page(900)
    out += [(200 + i, None, same) for i in range(40)] + [(300, "u", "x" * 999), (301, "u", "x" * 999), (302, "u", "y" * 1000), (303, "u", "y" * 1000)]
    out += [(400, "u", None), (401, None, ""), (None, "u", same), (None, None, "z" * 2000), (None, None, "z" * 2000), (210, None, same), (500, "big", page(200_000))]
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_round_trip(spark, tmp_path, parts):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, refers_to string").repartition(parts)
    path = f"file://{tmp_path}/w"
    m.write_warc(m.resolve_revisits(pages), path, train_bytes=60_000)
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in m.read_warc(spark, path).collect()]
    assert sorted(got, key=repr) == brute(rows())
    thin = m.read_warc(spark, path, payloads=False)
    assert "payload" not in thin.columns and thin.count() == len(got)


def test_archives_hold_a_dictionary_and_single_records(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    m.write_warc(m.resolve_revisits(pages).coalesce(1), f"file://{tmp_path}/w", train_bytes=60_000)
    [file] = glob.glob(f"{tmp_path}/w/part-*")
    with open(file, "rb") as f:
        data = f.read()
    frames = list(m.split_frames(memoryview(data)))
    assert frames[0][0] == m.SKIP_DICTIONARY and sum(k == m.FRAME_MAGIC for k, _ in frames) == len(rows())
    shared = zstandard.ZstdCompressionDict(bytes(frames[0][1]))
    assert shared.dict_id() != 0
    one = zstandard.ZstdDecompressor(dict_data=shared).decompress(next(f for k, f in frames[5:] if k == m.FRAME_MAGIC))
    assert one.startswith(b"WARC/1.1\r\nWARC-Type: ")
    # any reader that passes over skippable frames can read the whole stream
    whole = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(rows())


def test_frames_of_all_kinds():
    for size in (0, 1, 255, 256, 70_000, 400_000):
        for level, known, check in ((1, True, True), (3, False, False), (19, True, False)):
            data = bytes(random.Random(size).choices(b"ab", k=size))
            squeeze = zstandard.ZstdCompressor(level=level, write_content_size=known, write_checksum=check)
            frames = [squeeze.compress(data), squeeze.compress(data[: size // 2])]
            assert [bytes(f) for _, f in m.split_frames(memoryview(b"".join(frames)))] == frames


def test_empty_table_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    m.write_warc(m.resolve_revisits(pages), f"file://{tmp_path}/e")
    assert m.read_warc(spark, f"file://{tmp_path}/e").count() == 0
    record = m._record(1, "u", b"payload", None, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="damaged"):
        m._parse(record.replace(b"payload", b"pAyload"))
