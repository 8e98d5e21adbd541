"""The corpus operators against plain versions, on rows with every awkward case and on the smallest tables."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import decontamination, license_scans, minhash, quality_rules, queries, secret_scans, suffix_dedup, warc

SF = "/root/testdata/sf0.001"


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def same(df, names, want):
    assert rows(df, *names) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, brute.documents()).repartition(5)


@pytest.fixture(scope="module")
def table_rows(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    return [tuple(r) for r in read.select("doc_id", "text", "lang", "source").collect()]


NEAR = ["doc_id", "n_shingles", "component_id", "kept"]
LEAKS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SECRETS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
RULES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
LICENSES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
REPEATS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
PAGES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
ITEMS = [
    (1, brute.prose(70, 2)), (10, "Word"), (2, "MIT license"), (3, None), (4, ""), (5, brute.prose(200, 99)), (None, brute.prose(25, 4)),
    (6, "to be to be"), (7, "AAA BBB! ccc aaa, bbb ccc aaa bbb ccc aaa bbb"), (1, brute.prose(70, 2)),
]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, width):
    same(minhash.near_duplicates(docs, width=width), NEAR, brute.near_duplicates(brute.documents(), width))


def test_near_duplicate_links_outside_the_first_star(spark):
    """A chain of texts, each near the next only: every bucket's smallest member is far from most others."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[12 * i : 12 * i + 200]), "en", "s") for i in range(16)]
    same(minhash.near_duplicates(brute.frame(spark, chain), width=2), NEAR, brute.near_duplicates(chain))


def test_one_document_of_each_group_stays(docs):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = brute.near_duplicates(brute.documents(), 5)
    once = {(r[0], t) for r, (_, t, *_) in zip(want, brute.documents(), strict=True) if r[3] or r[0] is None}
    assert rows(kept, "doc_id", "text") == sorted(once, key=repr)


def test_contamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("key", F.lit(1))
    same(decontamination.contamination(docs, items), LEAKS, brute.contamination(brute.documents(), ITEMS))


def test_secrets(docs):
    found = secret_scans.find_secrets(docs, owner=F.col("source"), repository=F.col("lang"))
    same(found, SECRETS, brute.secrets(brute.documents()))
    thirteen = found.where("doc_id = 13").first()
    assert "github:" in thirteen["spans"] and thirteen["n_live"] >= 2


def test_shared_secrets_are_not_live(spark):
    value = "token = 'f3Kd92LmQx81ZpW0'"
    texts = [(i, f"x {value} y", "en", f"owner{i}") for i in range(5)] + [(9, "token = 'g7Hs62JkVb13QwE9'", "en", "owner9")]
    frame = brute.frame(spark, texts)
    found = secret_scans.find_secrets(frame, owner=F.col("source"))
    assert {r["doc_id"] for r in found.where("n_live > 0").collect()} == {9}
    masked = {r["doc_id"]: r["text"] for r in secret_scans.mask_secrets(frame, owner=F.col("source")).collect()}
    assert masked[9] == "[SECRET]'" and masked[0] == texts[0][1]


def test_masking_keeps_rows_and_columns(docs):
    masked = secret_scans.mask_secrets(docs, owner=F.col("source"))
    assert masked.columns == docs.columns and masked.count() == docs.count()
    twelve = masked.where("doc_id = 12").first()["text"]
    assert "Zx9kQ7mP2vL8" not in twelve and twelve.startswith("a [SECRET]")


def test_quality_rules(spark, docs):
    labels = spark.createDataFrame([(1, 1), (17, 0), (None, 1), (9, 1), (21, 0)], "doc_id long, quality int")
    judged = quality_rules.judge(docs, labels)
    same(judged, RULES, brute.quality(brute.documents()))
    assert judged.where("base_failed and kept").isEmpty()


def test_licenses(docs):
    found = license_scans.scan_licenses(docs)
    same(found, LICENSES, brute.licenses(brute.documents()))
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[16]["labels"] == "gpl" and by_id[16]["base_labels"] == "" and 0.8 < by_id[16]["score"] < 1
    assert by_id[15]["labels"] == "apache,gpl,mit" and by_id[15]["score"] == 1
    assert by_id[5]["labels"] == "" and by_id[5]["score"] == 0


def test_fuzzy_notice_with_every_number_of_edits():
    """Edits up to the bound are found wherever they stand; pieces, one more than edits, leave one piece whole."""
    scanner = license_scans.Scanner(license_scans.NOTICES)
    for i, notice in enumerate(scanner.notices):
        step = max(1, len(notice.text) // max(1, notice.edits))
        edited = list(notice.text)
        for e in range(notice.edits):
            at = e * step + step // 2
            edited[min(at, len(edited) - 1)] = "q"
        text = "some words before " + "".join(edited) + " and after"
        assert any(n == i for _, _, n, _ in scanner.find(text)), notice.text


def test_repeated_bytes(docs):
    same(suffix_dedup.repeated_spans(docs), REPEATS, brute.repeats(brute.documents()))


def test_repeated_bytes_by_window_hashes(docs):
    """Hashes with more segments than the bound go another way, to the same result."""
    same(suffix_dedup.repeated_spans(docs, most_segments=1), REPEATS, brute.repeats(brute.documents()))


def test_colliding_hashes_are_told_apart(monkeypatch):
    """With a hash that sees every string alike, the bytes still decide."""
    a, b = brute.prose(100, 1).encode()[:420], brute.prose(100, 2).encode()[:420]
    monkeypatch.setattr(suffix_dedup.Polynomial, "of", lambda self, p, start, length: start * 0)
    hits = suffix_dedup.repeated_windows([b"same head" + a, b"same head" + b, b"same head" + a[:400]], [0, 0, 0], 400)
    sizes = [30, 30, 10]
    first, second, third = hits[:30], hits[30:60], hits[60:]
    assert len(hits) == sum(sizes) and first[:10].all() and not second.any() and third.all() and not first[10:].any()


def pages_frame(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return df.withColumn("digest", F.lit("x")).withColumn("page", F.lit(1)).withColumn("payload", F.lit("y"))


PAGE_ROWS = [
    (3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (7, "http://c/\r\nX: y", ""), (4, "http://d/", "WARC/1.1\r\n\r\nx"),
    (1, "http://b/", "<p>é</p>"), (None, "http://e/", "null id"), (None, "http://f/", "<p>é</p>"), (9, "u", "z" * 300_000), (8, "u", "z" * 300_000),
]


def test_archives(spark, tmp_path):
    for name, least in (("all", 0), ("some", 5)):
        path = str(tmp_path / name)
        warc.write_archives(pages_frame(spark, PAGE_ROWS), path, least_bytes=least, records_per_archive=3)
        read = warc.read_archives(spark, path)
        resolved = warc.resolve(read).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
        same(resolved, PAGES, brute.warc(PAGE_ROWS, least))
        texts = {r["page_id"]: bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").collect()}
        assert texts["4"] == "WARC/1.1\r\n\r\nx" and read.select("record_id").distinct().count() == len(PAGE_ROWS)


def test_archives_of_others():
    """Records compressed one by one, in foreign header case."""
    import gzip

    record = b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = list(warc.records(gzip.compress(record) + gzip.compress(record)))
    assert [(h["warc-type"], b) for h, b in found] == [("resource", b"abc")] * 2
    with pytest.raises(ValueError):
        list(warc.records(record[:-8]))


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        minhash.near_duplicates(none), minhash.drop_near_duplicates(none), decontamination.contamination(none, items),
        secret_scans.find_secrets(none), secret_scans.mask_secrets(none), quality_rules.judge(none, labels),
        license_scans.scan_licenses(none), suffix_dedup.repeated_spans(none),
    ]
    assert all(df.isEmpty() for df in made)
    assert decontamination.contamination(docs, items).where("contaminated").isEmpty()
    warc.write_archives(pages_frame(spark, PAGE_ROWS).limit(0), str(tmp_path / "none"))
    assert warc.resolve(warc.read_archives(spark, str(tmp_path / "none"))).isEmpty()


CHECKS = {
    "op2_minhash_near_dedup": (NEAR, brute.near_duplicates), "op6_secret_scans": (SECRETS, brute.secrets),
    "op7_quality_rules": (RULES, brute.quality), "op9_license_scans": (LICENSES, brute.licenses),
    "op10_suffix_dedup": (REPEATS, brute.repeats),
}


@pytest.mark.parametrize("name", CHECKS)
def test_query_on_the_smallest_tables(spark, table_rows, name):
    names, plain = CHECKS[name]
    same(queries.QUERIES[name](spark, SF), names, plain(table_rows))


def test_decontamination_query(spark, table_rows):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute.contamination(table_rows, items)
    assert any(r[-1] for r in want)
    same(queries.QUERIES["op3_decontamination"](spark, SF), LEAKS, want)


def test_warc_query(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    same(queries.QUERIES["op5_warc"](spark, SF), PAGES, brute.warc(pages))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin_on_the_smallest_tables(spark, name):
    """The SQL twins against the plain versions; the queries themselves are held against both."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    docs = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    want = {
        "op2_minhash_near_dedup": lambda: brute.near_duplicates(docs),
        "op3_decontamination": lambda: brute.contamination(docs, con.execute("SELECT item_id, text FROM benchmark").fetchall()),
        "op5_warc": lambda: brute.warc(con.execute("SELECT page_id, url, html FROM pages").fetchall()),
        "op10_suffix_dedup": lambda: brute.repeats(docs),
    }[name]()
    assert sorted(con.execute(queries.SQL[name]).fetchall(), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("most_segments", [1, 1024])
def test_repeats_are_told_by_bytes_when_hashes_collide(spark, monkeypatch, most_segments):
    """Texts of one length whose segments and windows have equal hashes: some equal, some not, one inside another text."""
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda polynomial, text, at, length: (at * 0).astype("uint64"))
    rows = [(i, brute.prose(140, 50 + i % 4, 90), "en", "s") for i in range(6)]
    rows += [(10 + i, f"{brute.prose(60, 300 + i)} {brute.prose(110, 7)} {brute.prose(20 + i, 400 + i)}", "en", "s") for i in range(3)]
    frame = brute.frame(spark, rows).repartition(3)
    found = suffix_dedup.repeated_spans(frame, length=200, gram=20, most_segments=most_segments, digest_of=len)
    found_rows = rows_of(found)
    monkeypatch.undo()
    plain = suffix_dedup.repeated_spans(frame, length=200, gram=20)
    same(plain, REPEATS, found_rows)
    assert 0 < sum(r[2] for r in found_rows) < sum(r[1] for r in found_rows)


def rows_of(df):
    return [tuple(r) for r in df.select(*REPEATS).collect()]


def test_contamination_of_repetitive_texts(spark):
    """A million equal words against items of many equal words: time follows the length of both."""
    rows = [(1, "spam " * 1_000_000, "en", "s"), (2, "ham spam " * 30_000 + "spam " * 8, "en", "s"), (3, "a b c a b c a b c a b c", "en", "s")]
    items = [(1, "spam " * 100_000), (2, "ham " * 20), (3, "spam ham " * 40_000), (4, "b c a b c a b c a b"), (5, "spam spam spam")]
    found = decontamination.contamination(brute.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in found.collect()}
    assert got[1] == (1_000_000, ["1", "5"])
    assert got[2] == (60_008, ["3", "5"])
    assert got[3] == (10, ["4"])


@pytest.mark.parametrize("period", [1, 2, 3, 5, 6, 7, 11])
def test_thinned_fingerprints_are_in_every_window(period):
    words = np.tile(np.arange(period), 200)[:137].astype(np.uint64)
    hashes = decontamination.shingle_hashes(decontamination.mix64(words), 5)
    at = decontamination.winnow(hashes, 6)
    for low in range(len(hashes) - 5):
        inside = at[(at >= low) & (at < low + 6)]
        assert hashes[low : low + 6].min() in hashes[inside]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 16])
def test_numbers_of_windows(size):
    codes = np.random.default_rng(size).integers(0, 3, 300)
    numbers = decontamination.window_numbers(codes, size)
    spelled = [tuple(codes[i : i + size]) for i in range(len(codes) - size + 1)]
    assert len(numbers) == len(spelled)
    for i in range(0, len(spelled), 7):
        assert [n == numbers[i] for n in numbers] == [s == spelled[i] for s in spelled]


def test_ownership_tells_examples_from_credentials(spark):
    """Thirty owners; copied examples, and keys of one owner that also stand without a keyword in that owner's other texts."""
    import random

    draw = random.Random(8)
    value = lambda: "".join(draw.choice("abcdefghjkmnpqrstuvwxyzABCDEFGH23456789") for _ in range(24))
    shared, own, rows, truth = [value() for _ in range(5)], {}, [], {}
    for i in range(30):
        own[i] = value()
        rows.append((10 * i, f"the token = '{own[i]}' of {i}", "en", f"owner{i}"))
        rows.append((10 * i + 1, f"curl -u {own[i]} https://host/{value().lower()[:9]} done", "en", f"owner{i}"))
        rows.append((10 * i + 2, f"as in the manual: password={shared[i % 5]} or {shared[(i + 1) % 5]}", "en", f"owner{i}"))
        rows.append((10 * i + 3, f"nothing here but {value()} of nobody", "en", f"owner{i}"))
        truth |= {10 * i: 1, 10 * i + 1: 1, 10 * i + 2: 0, 10 * i + 3: 0}
    found = {r["doc_id"]: r for r in secret_scans.find_secrets(brute.frame(spark, rows), owner=F.col("source")).collect()}
    assert {i: found[i]["n_live"] for i in truth} == truth  # precision and recall of 1 on the planted cases
    assert all(found[10 * i + 1]["spans"] == f"known:8:{8 + 24}" and found[10 * i + 1]["n_known"] == 1 for i in range(30))
    assert all(found[10 * i + 2]["n_shared"] == 1 and found[10 * i + 3]["spans"] == "" for i in range(30))
    masked = secret_scans.mask_secrets(brute.frame(spark, rows), owner=F.col("source"))
    texts = {r["doc_id"]: r["text"] for r in masked.select("doc_id", "text").collect()}
    assert all(own[i] not in texts[10 * i] + texts[10 * i + 1] for i in range(30))
    assert all(texts[r[0]] == r[1] for r in rows if r[0] % 10 > 1)


def test_license_places_in_a_long_text():
    """Ten megabytes of one phrase: word numbers follow from the place before, not from the start."""
    import time

    text = "mit license " * 800_000
    start = time.process_time()
    places = license_scans.exact_places(text.strip())
    assert time.process_time() - start < 10
    assert len(places) == 800_000 and places[-1] == (1_599_998, "mit")
