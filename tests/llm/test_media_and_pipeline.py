import hashlib
import zlib

from tidewake.llm import mpegaudio as M


def test_media_round_trip(spark):
    texts = [(1, "héllo " * 500), (1, "héllo " * 500), (2, ""), (3, None), (None, "x"), (4, "y" * 576)]
    df = spark.createDataFrame([(k, t, "c") for k, t in texts], "doc_id long, text string, media string")
    got = M.digest_column(M.encode_column(df)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6
    for k, t in texts:
        data = (t or "").encode()
        payload = M.pad(data)
        r = by[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 and payload and f"frames={len(payload) // 576};" in r["feature"]
    assert M.encode_column(df.limit(0)).count() == 0


def test_parser_resynchronises_and_checks():
    payload = M.pad(b"abc" * 1000)
    data = M.write(payload, "tïtle")
    stream = M.parse(data)
    assert stream.tags["TIT2"] == "tïtle" and stream.table == "Info" and stream.table_frames == len(payload) // 576 == len(stream.seek)
    assert stream.samples == len(stream.seek) * 576 and stream.seconds == stream.samples / 16000 and stream.crc_errors == 0
    assert M.read_payload(data, stream) == payload and M.feature(M.parse_regular(data)) == M.feature(stream)
    junk = b"\xff\xfb\x00junk" + data[: stream.seek[2]] + b"\xff\xffgarbage\xff" + data[stream.seek[2] :] + b"TAG" + b"Song".ljust(125, b"\0")
    again = M.parse(junk)
    assert len(again.seek) == len(stream.seek) and again.skipped >= 9 and again.tags["title"] == "Song"
    broken = bytearray(data)
    broken[stream.seek[1] + 8] ^= 1
    assert M.parse(bytes(broken)).crc_errors == 1
    for n in range(0, 40, 7):
        M.parse(data[:n])


def test_headers():
    head = M.read_header(b"\xff\xfb\x90\x00", 0)
    assert (head.version, head.layer, head.bit_rate, head.rate, head.size, head.samples) == (1, 3, 128000, 44100, 417, 1152)
    assert M.read_header(b"\xff\xfb\xf0\x00", 0) is None and M.read_header(b"\xff", 0) is None
    head = M.read_header(M.HEADER, 0)
    assert (head.version, head.layer, head.rate, head.size, head.side) == (2, 3, 16000, M.FRAME, M.SIDE)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import random

    import corpus_pipeline
    from tests.llm.test_mixing import mix_by_hand
    from tests.llm.test_text_operators import labelled, words

    rng = random.Random(11)
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t, _ in labelled(rng, 160)]
    toxic = {k for k in range(0, 160, 4)}
    item = " ".join(words(rng, 25))
    rows += [(200, rows[1][1], "en", "s0", 1), (201, rows[2][1] + " end", "en", "s1", 1), (202, " ".join(words(rng, 30)) + " " + item, "en", "s2", 1), (203, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in kept]
    clean = set(range(160)) - toxic | {200, 201, 202, 203}
    assert len(set(ids[0]) ^ clean) <= 6
    assert set(ids[1]) == set(ids[0]) - {200, 201} and set(ids[2]) == set(ids[1]) - {202}
    sized = [(k, s, len((t or "").split())) for k, t, _, s, _ in rows if k in set(ids[2])]
    taken, _ = mix_by_hand(sized)
    assert sorted(k for k, n in taken.items() for _ in range(n)) == ids[3] == ids[4]
    assert all(d.columns == kept[0].columns for d in kept[:4])
    final = sorted(map(tuple, kept[4].collect()), key=lambda r: r[1])
    assert [r[0] for r in final] == ids[3] and final[0][1] == 0


def test_a_payload_that_looks_like_a_tag_is_read_back():
    payload = M.pad(b"x" * 505 + b"TAG" + b"y" * 100)
    for text in (payload, b"z" * 576 * 2 + b"x" * 520 + b"TAG" + b"w" * 53):
        data = M.write(M.pad(text))
        for parse in (M.parse, M.parse_regular):
            stream = parse(data)
            assert M.read_payload(data, stream) == M.pad(text) and not stream.skipped
            assert len(stream.table_seek) == 100 and stream.tags["title"] == "payload"


def test_index_column_holds_durations_and_offsets(spark):
    df = spark.createDataFrame([(1, "a" * 1000, "t"), (1, "a" * 1000, "t"), (None, None, "t")], "doc_id long, text string, tags string")
    rows = M.index_column(M.encode_column(df)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 3 and by[1]["seconds"] == 2 * 576 / 16000 and by[1]["frames"] == 2 and by[1]["seek"][1] - by[1]["seek"][0] == M.FRAME
    assert by[None]["frames"] == 1 and by[1]["tags"]["TIT2"] == "payload" and by[1]["crc_errors"] == 0
    assert M.index_column(M.encode_column(df).limit(0)).count() == 0
