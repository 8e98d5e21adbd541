"""Learned operators, sampled segmentations, paragraph dedup and the pipeline."""

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from modelwatch.llm import paragraph_dedup, quality_classifier, quality_rules, sentence_pieces
from modelwatch.llm.components import connected_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark, brute.documents()).repartition(5)


def labelled(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.col("doc_id") % 4 == 1
    return spark.read.parquet(f"{SF}/documents.parquet"), labels.where(~held), labels.where(held)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 230)]
    got = connected_components(spark.createDataFrame([*path, *star, (5, 5)], "x long, y long"), "test")
    want = {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 230)}}
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "x long, y long"), "test").isEmpty()


def test_quality_rules_on_held_out_labels(spark):
    docs, known, held = labelled(spark)
    judged = quality_rules.judge(docs, known).join(held, "doc_id").where("not base_failed").toPandas()
    assert (judged["kept"] == (judged["quality"] == 1)).mean() > 0.95


def test_monotonic_features():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 1]) + 0.2 * rng.random(2000)) > 0.7).astype(float)
    forest = quality_rules.fit_forest(x, y, [1, 0, -1])
    assert ((forest.probability(x) > 0.5) == (y == 1)).mean() > 0.85
    for j, direction in ((0, 1), (2, -1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(forest.margin(grid).reshape(50, 40), axis=1) * direction
        assert (steps >= -1e-12).all()
    assert np.unique(quality_rules.fit_forest(x, np.ones(2000), [1, 0, -1]).probability(x)).size == 1


def test_labellers_accuracies_are_recovered():
    rng = np.random.default_rng(2)
    fault = np.where(rng.random(20_000) < 0.2, rng.integers(1, 4, 20_000), 0)
    votes = np.zeros((20_000, 4), int)
    alarms, misses = [0.02, 0.05, 0.01], [0.05, 0.1, 0.1]
    for j in range(3):
        bad = np.where(fault == j + 1, rng.random(20_000) >= misses[j], rng.random(20_000) < alarms[j])
        votes[:, j] = np.where(rng.random(20_000) < 0.3, 0, np.where(bad, 2, 1))
    known = rng.random(20_000) < 0.3
    votes[known, 3] = np.where(fault[known] > 0, 2, 1)
    model = quality_classifier.fit_votes(votes, np.ones(len(votes)))
    for j in range(3):
        assert abs(2 * model.chances[j, 0, 2] - alarms[j]) < 0.03
        assert abs(2 * model.chances[j, j + 1, 1] - misses[j]) < 0.1
    # Faults whose own labeller is silent cannot be seen: the measure is what the true chances reach.
    chances = np.full((4, 4, 3), 0.5)
    for j in range(3):
        for kind in range(4):
            p = 1 - misses[j] if kind == j + 1 else alarms[j]
            chances[j, kind, 1:] = (1 - p) / 2, p / 2
    chances[3, 0, 1:], chances[3, 1:, 1:] = (0.499, 0.001), (0.001, 0.499)
    best = quality_classifier.VoteModel(np.array([0.8, 0.2 / 3, 0.2 / 3, 0.2 / 3]), chances)
    right = [((m.posterior(votes) > 0.5) == (fault > 0)).mean() for m in (model, best)]
    assert right[0] > right[1] - 0.02, right


def test_classifier_on_held_out_labels(spark):
    docs, known, held = labelled(spark)
    judged = quality_classifier.classify(docs, known).join(held, "doc_id").toPandas()
    clean = (judged["quality"] == 1) & (judged["toxic"] == 0)
    assert judged["kept"][clean].mean() > 0.97
    assert (~judged["kept"][judged["quality"] == 0]).mean() > 0.8
    assert (~judged["kept"][judged["toxic"] == 1]).mean() > 0.5


def test_classifier_on_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (17, 0, 0), (None, 1, 1), (21, 0, None), (21, None, 0)], "doc_id long, quality int, toxic int")
    judged = quality_classifier.classify(docs, labels)
    assert judged.count() == docs.count() and judged.where("kept is null").isEmpty()
    good = quality_classifier.keep_good(docs, labels)
    assert good.columns == docs.columns and good.count() == judged.where("kept").count()
    none = quality_classifier.classify(docs.limit(0), labels.limit(0))
    assert none.isEmpty() and quality_classifier.classify(docs, labels.limit(0)).count() == docs.count()


def test_pieces_are_lossless_and_reproducible(docs):
    first = sentence_pieces.encode_documents(docs)
    assert first.where("not lossless").isEmpty() and first.columns[: len(docs.columns)] == docs.columns
    again = sentence_pieces.encode_documents(docs.repartition(3))
    pairs = {tuple(r) for r in first.select("doc_id", "text", "ids_sha256").collect()}
    assert pairs == {tuple(r) for r in again.select("doc_id", "text", "ids_sha256").collect()}
    other = sentence_pieces.encode_documents(docs, seed=1)
    assert pairs != {tuple(r) for r in other.select("doc_id", "text", "ids_sha256").collect()}
    back = sentence_pieces.decode_documents(first.drop("text"))
    want = {(i, t or "") for i, t, *_ in brute.documents()}
    assert {(r["doc_id"], r["text"]) for r in back.select("doc_id", "text").collect()} == want
    assert sentence_pieces.encode_documents(docs.limit(0)).isEmpty()


def test_odd_characters_come_back():
    vocabulary = sentence_pieces.Vocabulary()
    texts = ["", " ", "  a  ", "▁", "a▁b ▁▁ c", "\0\n\t", "é日😀\U0010ffff￿", "x" * 3000, "<0x41> </s>"]
    sizes, ids = sentence_pieces.sample_pieces(vocabulary, texts, range(len(texts)))
    for text, end, n in zip(texts, np.cumsum(sizes), sizes, strict=True):
        assert sentence_pieces.decode_pieces(vocabulary, ids[end - n : end].tolist()).decode() == text


@pytest.mark.parametrize("alpha", [0.0, 0.3])
def test_samples_follow_the_lattice(alpha):
    """Frequencies of whole segmentations against their weights, enumerated."""
    vocabulary, word, draws = sentence_pieces.Vocabulary(), "▁there", 20_000
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.DEFAULT_MODEL)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not sp.is_byte(i) and i > 2}

    def paths(at):
        if at == len(word):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, len(word) + 1):
            if (i := ids.get(word[at:end])) is not None:
                out += [((i, *rest), alpha * vocabulary.weight[i] + w) for rest, w in paths(end)]
        return out

    want = {p: np.exp(w) for p, w in paths(0)}
    total = sum(want.values())
    sizes, flat = sentence_pieces.sample_pieces(vocabulary, ["there"] * draws, range(draws), alpha)
    ends = np.cumsum(sizes)
    got = {}
    for n, end in zip(sizes, ends, strict=True):
        path = tuple(flat[end - n : end].tolist())
        got[path] = got.get(path, 0) + 1
    assert set(got) <= set(want)
    for path, w in want.items():
        p = w / total
        assert abs(got.get(path, 0) / draws - p) < 5 * np.sqrt(p * (1 - p) / draws) + 1e-9


def test_classifier_sample_has_one_row_of_each_id(spark, monkeypatch):
    """A labelled id that fifty rows repeat does not fill the driver."""

    class Sampled(Exception):
        pass

    def stop(sample, toxic):
        raise Sampled(len(toxic))

    monkeypatch.setattr(quality_classifier, "learned_words", stop)
    rows = [(7, brute.prose(30, i), "en", "s") for i in range(50)] + [(100 + i, brute.prose(30, i), "en", "s") for i in range(10)]
    labels = spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int")
    with pytest.raises(Sampled) as seen:
        quality_classifier.fit_scorers(brute.frame(spark, rows), labels, most_train_rows=5)
    assert seen.value.args == (5,)


PASSAGE = brute.prose(60, 42, 3000)


def planted():
    """Twelve documents with one passage inside their text, twelve without, a near copy of a paragraph, short lines."""
    rows = [(i, f"{brute.prose(80 + i, 100 + i, 9000)} {PASSAGE} {brute.prose(50 + i, 200 + i, 9000)}", "en", "s") for i in range(12)]
    rows += [(i, brute.prose(150, 300 + i, 9000) + "\na short line", "en", "s") for i in range(20, 32)]
    return rows


def test_repeated_passages_go_and_clean_documents_stay(spark):
    docs = brute.frame(spark, planted())
    found = paragraph_dedup.repeated_paragraphs(docs)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert by_id[0]["n_removed"] == 0
    assert all(by_id[i]["n_words_removed"] >= 15 and by_id[i]["copies_of"] == [0] for i in range(1, 12))
    assert all(by_id[i]["n_removed"] == 0 for i in range(20, 32))
    cut = {r["doc_id"]: r["text"] for r in paragraph_dedup.without_repeats(docs, found).collect()}
    whole = {i: t for i, t, *_ in planted()}
    for i, text in cut.items():
        gone = len(whole[i].split()) - len(text.split())
        assert gone == by_id[i]["n_words_removed"]
        assert set(whole[i].split()) - set(text.split()) <= set(PASSAGE.split())


def test_paragraphs_cover_every_word_once():
    """Alone or together, texts fall into the same lines and pieces, and these hold every word."""
    texts = [(t or "").encode() for _, t, *_ in brute.documents()]
    together = paragraph_dedup.paragraphs(texts)
    assert np.array_equal(np.append(together.start, sum(len(t.split()) for t in texts)), np.append(0, together.end))
    for i, raw in enumerate(texts):
        alone, own = paragraph_dedup.paragraphs([raw]), together.text == i
        pieces = own[together.line] if len(own) else own
        assert np.array_equal(alone.start + together.first_word[i], together.start[pieces])
        assert np.array_equal(alone.digests, together.digests[pieces])
        assert np.array_equal(alone.bands, together.bands[own]) and np.array_equal(alone.line_digests, together.line_digests[own])


@pytest.mark.parametrize("period", range(1, 8))
def test_repetitive_text_is_cut_into_long_enough_paragraphs(spark, period):
    """A line that says the same 1 to 7 words again and again, alone and inside other text."""
    line = " ".join(f"p{i % period}" for i in range(60))
    inside = f"{brute.prose(40, 71, 9000)} {line} {brute.prose(40, 72, 9000)}"
    for text in (line, inside):
        made = paragraph_dedup.paragraphs([text.encode()])
        assert (made.end - made.start).min() >= paragraph_dedup.PIECE_WORDS
    rows = [(i, f"{brute.prose(30, i, 9000)}\n{line}", "en", "s") for i in (1, 2)]
    found = {r["doc_id"]: r for r in paragraph_dedup.repeated_paragraphs(brute.frame(spark, rows)).collect()}
    assert found[2]["n_words_removed"] == 60


def test_copies_lose_all_their_words_and_repeated_lines_go(spark):
    """Exact copies of sample documents, one of a single word among them; a 9-word line between texts of its own."""
    sample = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text").collect()
    rows = [(1000 * i + r["doc_id"], r["text"], "en", "s") for i in range(2) for r in sample] + [(9000, "Once", "en", "s"), (9001, "once", "en", "s")]
    line = brute.prose(9, 77, 9000)
    rows += [(9100 + i, f"{brute.prose(30, 500 + i, 9000)}\n{line}\n{brute.prose(30, 600 + i, 9000)}", "en", "s") for i in range(3)]
    docs = brute.frame(spark, rows)
    found = paragraph_dedup.repeated_paragraphs(docs)
    by_id = {r["doc_id"]: r for r in found.collect()}
    for i, text, *_ in rows:
        if 1000 <= i < 2000 or i == 9001:
            assert by_id[i]["n_words_removed"] == len((text or "").encode().split()) and by_id[i]["n_removed"] == by_id[i]["n_paragraphs"]
    assert [by_id[9100 + i]["n_words_removed"] for i in range(3)] == [0, 9, 9]
    cut = {r["doc_id"]: r["text"] for r in paragraph_dedup.without_repeats(docs, found).collect()}
    assert not cut[9001] and line not in cut[9101] and not any((cut[i] or "").split() for i in range(1000, 1060) if i in cut)


def test_near_paragraphs_are_linked(spark):
    """Two lines of one paragraph each that differ in their last word only: 17 shingles each, 16 of them shared."""
    def alone(text):
        return len(paragraph_dedup.paragraphs([text.encode()]).start) == 1

    lines = (brute.prose(21, seed, 9000) for seed in range(2000))
    line = next(x for x in lines if alone(x) and alone(x.rsplit(" ", 1)[0] + " other"))
    other = line.rsplit(" ", 1)[0] + " other"
    rows = [(1, line + "\n" + brute.prose(40, 11, 9000), "en", "s"), (2, brute.prose(40, 12, 9000) + "\n" + other, "en", "s")]
    found = {r["doc_id"]: r for r in paragraph_dedup.repeated_paragraphs(brute.frame(spark, rows)).collect()}
    assert found[1]["n_removed"] == 0 and found[2]["n_words_removed"] == 21 and found[2]["copies_of"] == [1]


def test_near_lines_go_whole_and_passages_to_their_last_word(spark):
    """Lines of 50, 110 and 200 words with 1, 2 and 4 changed words; a passage inside other text, from end to end."""
    rows, sizes = [], {}
    for i in range(30):
        n, edits = [(50, 1), (110, 2), (200, 4)][i % 3]
        words = brute.prose(n, 800 + i, 9000).split()
        rows.append((i, " ".join(words), "en", "s"))
        for j in range(edits):
            words[(j + 1) * n // (edits + 1)] = f"new{i}x{j}"
        rows.append((100 + i, " ".join(words), "en", "s"))
        sizes[100 + i] = n
    rows += [(i + 300, t, *more) for i, t, *more in planted()[:12]]
    found = {r["doc_id"]: r["n_words_removed"] for r in paragraph_dedup.repeated_paragraphs(brute.frame(spark, rows)).collect()}
    assert {i: found[i] for i in sizes} == sizes
    assert found[300] == 0 and all(found[i] == 60 for i in range(301, 312))


def test_words_that_resume_after_an_edit():
    same = lambda a, b: paragraph_dedup.resumed(a.split(), b.split())
    assert same("a b c d", "a b x d e f") == 2 and same("", "a") == 0 and same("a b", "a b c") == 2
    assert same("a b X c d e f g", "a b Y c d e f z") == 7  # another word, four equal ones behind it
    assert same("a b c d e f", "a b Y c d e f") == 6 and same("a b X Y c d e f", "a b c d e f") == 8
    assert same("a X c d e Z g h i j", "a c d e W g h i j") == 1  # too few equal words between the edits


@pytest.mark.parametrize("words,edits", [(60, 0), (60, 1), (100, 1), (100, 2), (200, 3)])
def test_near_passages_inside_other_text_lose_nine_words_of_ten(spark, words, edits):
    """Forty pairs of documents that share a passage with changed words, each inside text of its own."""
    rows, lost = [], 0
    for i in range(40):
        passage = brute.prose(words, 5000 + 100 * edits + i, 9000).split()
        around = [brute.prose(30 + i % 9, 7000 + 10 * i + j, 9000) for j in range(4)]
        rows.append((i, f"{around[0]} {' '.join(passage)} {around[1]}", "en", "s"))
        for j in range(edits):
            passage[(j + 1) * words // (edits + 1) - i % 7] = f"new{i}x{j}"
        rows.append((100 + i, f"{around[2]} {' '.join(passage)} {around[3]}", "en", "s"))
    found = {r["doc_id"]: r["n_words_removed"] for r in paragraph_dedup.repeated_paragraphs(brute.frame(spark, rows)).collect()}
    assert all(found[i] == 0 for i in range(40)) and all(found[100 + i] <= words for i in range(40))
    lost = sum(found[100 + i] for i in range(40))
    print(words, edits, lost / (40 * words))
    assert lost >= 0.9 * 40 * words


@pytest.mark.parametrize("slice_bytes", [7, 64, 1 << 22])
def test_words_are_found_and_hashed_as_split_finds_them(monkeypatch, slice_bytes):
    monkeypatch.setattr(paragraph_dedup, "SLICE", slice_bytes)
    for text in (b"", b" \n", b"one", b" a  b\tc\x0bd\x0ce\rf\n\ng ", b"x" * 50 + b" y " + b"z" * 20, "é 日本 ü a".encode(), brute.prose(300, 3).encode()):
        at, hashes = paragraph_dedup.hashed_words(text)
        words = text.split()
        assert [text[a : a + len(w)] for a, w in zip(at, words, strict=True)] == words
        assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))


def plain_repeats(rows, least_words, least_run_words):
    """Words removed per (doc_id, text), from all pairs of lines and all equal pieces; the cuts are the operator's own."""
    lines, pieces = [], []
    for n, (i, text) in enumerate(rows):
        p = paragraph_dedup.paragraphs([(text or "").encode()])
        spoken = (text or "").encode().lower().split()
        place = ((i is not None, i or 0), n)
        lines += [(place, k, a, b, tuple(spoken[a:b])) for k, (a, b) in enumerate(zip(p.line_start, p.line_end, strict=True))]
        pieces += [(place, k, a, b, tuple(spoken[a:b]), p.line[k]) for k, (a, b) in enumerate(zip(p.start, p.end, strict=True))]
    shingles = [{w[j : j + 5] for j in range(max(1, len(w) - 4))} for *_, w in lines]
    group = list(range(len(lines)))
    for x in range(len(lines)):
        for y in range(x):
            common = len(shingles[x] & shingles[y])
            if group[x] != group[y] and 100 * common >= 80 * (len(shingles[x]) + len(shingles[y]) - common):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    first = {}
    for g, line in sorted(zip(group, lines, strict=True), key=lambda x: x[1][:2]):
        first.setdefault(g, line[:2])
    gone = {n: [] for n in range(len(rows))}
    whole = set()
    for g, (place, k, a, b, _) in zip(group, lines, strict=True):
        if first[g] != (place, k):
            gone[place[1]].append((a, b, True))
            whole.add((place, k))
    left = sorted((p for p in pieces if (p[0], p[5]) not in whole), key=lambda p: p[:2])
    seen = {}
    for place, k, a, b, w, line in left:
        if w in seen:
            gone[place[1]].append((a, b, False))
        seen.setdefault(w, (place, k))
    out = []
    for n, (_, text) in enumerate(rows):
        spans, total = [], len((text or "").split())
        for a, b, is_line in sorted(gone[n]):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
                spans[-1][2] |= is_line and b - a >= least_words
            else:
                spans.append([a, b, is_line and b - a >= least_words])
        out.append(sum(b - a for a, b, line in spans if line or b - a >= min(least_run_words, total)))
    return out


@pytest.mark.parametrize("least", [(6, 15), (0, 0)])
def test_units_links_and_components_against_all_pairs(spark, monkeypatch, least):
    """Lines near and equal, in groups and chains; equal pieces of other lines, here not extended."""
    monkeypatch.setattr(paragraph_dedup, "resumed", lambda a, b: 0)
    rows = []
    for i in range(12):
        words = brute.prose(40, 900 + i % 3, 9000).split()
        for j in range(i // 3):
            words[5 + 9 * j] = f"e{i}x{j}"
        rows.append((i, f"{' '.join(words)}\nown line {i} of few\n{brute.prose(25, 40 + i, 9000)}\nshort line\nSame line of seven words in all"))
    rows += [(20, None), (21, " \n"), (3, rows[3][1] + "\nmore"), (None, rows[5][1] + "\nnull " * 3)]
    frame = brute.frame(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    found = paragraph_dedup.repeated_paragraphs(frame, least_words=least[0], least_run_words=least[1])
    got = sorted(((r["doc_id"], r["n_words_removed"]) for r in found.collect()), key=repr)
    want = sorted(((i, n) for (i, _), n in zip(rows, plain_repeats(rows, *least), strict=True)), key=repr)
    assert got == want


def test_paragraphs_of_awkward_rows(docs):
    found = paragraph_dedup.repeated_paragraphs(docs)
    assert found.count() == docs.count()
    assert found.where("doc_id in (4, 5, 6) and (n_paragraphs <> 0 or n_removed <> 0)").isEmpty()
    assert found.where("doc_id = 2 and n_removed > 0").count() == 1
    assert paragraph_dedup.without_repeats(docs, found).count() == docs.count()
    assert paragraph_dedup.repeated_paragraphs(docs.limit(0)).isEmpty()


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a plain version on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, docs)
        assert docs.columns[: len(columns)] == columns and not docs.isEmpty()
    pick = lambda df: [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = kept["MinHash near-dedup"]
    assert ids(after) == {r[0] for r in brute.near_duplicates(pick(before), 5) if r[3]}
    before, after = kept["benchmark decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(after) == {r[0] for r in brute.contamination(pick(before), items) if not r[-1]}
    before, after = kept["secret scans"]
    assert ids(after) == ids(before) and after.where("n_chars <> length(text)").isEmpty()
    before, after = kept["SentencePiece encoding"]
    assert ids(after) == ids(before) and after.where("not lossless").isEmpty()


def test_pipeline_on_awkward_rows(spark, docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (17, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, brute.prose(70, 2)), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns[: len(docs.columns)] == docs.columns and out.where("not lossless").isEmpty()
    assert out.where("doc_id in (10, 11)").isEmpty()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).isEmpty()
