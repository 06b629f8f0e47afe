"""Extraction, encoding, scoring, classification and the pipeline."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparktab.llm import attention, extraction, lstm, pieces, resampling, scoring, tags

from .conftest import sentence, table

tokenizers = pytest.importorskip("public_tokenizers")
MODEL = tokenizers.path("piece_bpe_32k.model")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def numeric(loss, parameters, name, spot, h=1e-4):
    low, high = ({n: v.copy() for n, v in parameters.items()} for _ in range(2))
    low[name][spot] -= h
    high[name][spot] += h
    return (loss(high) - loss(low)) / (2 * h)


# -- HTML ------------------------------------------------------------------------------


def test_leaf_blocks():
    html = (
        '<!doctype html><title>no</title><body><p>a &lt;b&gt; &amp;amp; <b>c<p>d<script>if(a<b){"</p>"}</script> e'
        '<!-- <p>gone --><ul><li>x<li><a href="q>r">y</a></ul><table><tr><td>1<td>2</table>line<br>two &copy; < 3'
    )
    texts = [(b.path[-1], b.text) for b in tags.leaf_blocks(html)]
    assert texts == [
        ("p", "a <b> &amp; c"), ("p", "d"), ("p", "e"), ("li", "x"), ("li", "y"), ("td", "1"), ("td", "2"),
        ("body", "line two © < 3"),
    ]
    assert tags.leaf_blocks("") == [] and tags.leaf_blocks("<<<>>") != []
    assert tags.leaf_blocks("<p " + "a='" * 20000) is not None  # no quadratic scanning


def words(html):
    return [b.text for b in tags.leaf_blocks(html)]


def test_no_text_is_lost_around_odd_markup():
    assert words('<article><p>a</p><svg width="1"/><p>b</p><math/><p>c</p>') == ["a", "b", "c"]
    assert words("<p>a<!-->b</p><p>c<!--->d</p><!-- x --><p>e<!-- y --!>f</p><!-- z") == ["ab", "cd", "ef"]
    assert words("<p>one</br>two<br/>three</p>") == ["one two three"]
    assert words("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>") == ["so x=2 holds"]
    assert words("<p>a</p><svg><g><svg><text>in</text></svg><text>out</text></g></svg><p>b</p>") == ["a", "b"]
    assert words("<svg><circle/><p>kept</p><p>too</p>") == ["kept", "too"]
    assert words("<svg><foreignObject><p>in</p></foreignObject><text>x</text></svg>after") == ["after"]
    assert words("<object><object>in</object>still in</object>after") == ["after"]
    assert words("<script>if (a < b) { '<script>' }</script>after<style>p > a {}</style>end") == ["after", "end"]
    assert words("<script/>gone</script>after") == ["after"]


def test_sampled_pages_are_whole(spark):
    """Places and link shares of a sampled page are those that scoring sees."""
    html = "<main>" + "".join(f"<p>{'long ' * 400}{i} <a>link</a></p>" for i in range(130)) + "</main>"
    huge = "<main>" + "<p>x</p>" * (extraction.SAMPLE_BLOCKS + 1) + "</main>"
    frame = spark.createDataFrame([(html,), (html,), (huge,), ("",)], "html string")
    ((paths, content),) = extraction.sample_pages(frame, 5)
    page = tags.leaf_blocks(html)
    assert paths == [b.path for b in page]
    vectors = extraction.Vectors()
    assert (vectors.joined(paths, content) == vectors.page(page)).all()


def test_lstm_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lstm.first_parameters(5).items()}
    x, live = lstm.pad([rng.standard_normal((n, 5)) for n in (3, 7, 1)])
    wanted = (rng.random(live.shape) > 0.5).astype(float)
    _, grads = lstm.gradient(p, x, live, wanted, live)
    for name in p:
        spot = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        want = numeric(lambda q: lstm.gradient(q, x, live, wanted, live)[0], p, name, spot)
        assert grads[name][spot] == pytest.approx(want, rel=1e-2, abs=1e-4)


def page(rng, n):
    body = [sentence(rng, rng.randint(6, 20)) for _ in range(n % 5 + 1)]
    article = "".join(f"<p>{s}</p>" for s in body)
    html = (
        f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home {n}</a></li></ul></nav>"
        f"<div class='ad'>Buy {n}</div><article><h1>Head &amp; {n}</h1>{article}"
        f"<section class='comments'><p>{sentence(rng, 9)}</p></section></article><footer>&copy; {n}</footer>"
    )
    return html, "\n".join([f"Head & {n}", *body])


def test_extraction_of_held_out_pages(spark):
    rng = random.Random(1)
    made = [page(rng, n) for n in range(160)]
    rows = [(n, f"u{n}", html) for n, (html, _) in enumerate(made)] + [(900, "u", None), (901, None, ""), (0, "u0", made[0][0])]
    rows += [(902, "long", made[1][0].replace("<h1>", "<p>more text of the article</p>" * 3000 + "<h1>"))]
    # Several hundred comments of readers behind the article change nothing.
    tail = "".join(f"<div class='comment'><p>{sentence(rng, 9)}</p></div>" for _ in range(500))
    rows += [(903, "tail", made[2][0].replace("</body>", f"<section class='comments'>{tail}</section></body>"))]
    frame = table(spark, rows, "page_id bigint, url string, html_text string")
    found = extraction.extract_text(frame, ["page_id", "url"], "html_text", sample=40).collect()
    assert len(found) == len(rows)
    right = sum(r.text == made[r.page_id][1] for r in found if r.page_id < 900)
    assert right >= 158
    by_id = {r.page_id: r for r in found}
    assert by_id[900].text == by_id[901].text == "" and by_id[902].main_blocks > 2900
    assert by_id[903].text == made[2][1]


def test_extraction_without_pages(spark):
    frame = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    assert extraction.extract_text(frame.where("false"), ["page_id"]).count() == 0
    assert extraction.extract_text(frame, ["page_id", "url"]).first().text == ""


# -- SentencePiece ---------------------------------------------------------------------

ODD = [
    "", " ", "a", " a", "a  b", "a▁b", "x\n y\t\tz", "▁", "a ", "a  ", "   ", "</s> hi", "é ﬁ", "\0a", "日本😀 x" * 9, None,
    "a" * 5000, " " * 100 + "x" + " " * 33, "▁ ▁a▁▁ b", "<0x0A> <unk>", "word " * 4000,
]


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert pieces.splits_at_markers(library)
    rows = [(1000 + n, t) for n, t in enumerate(ODD)] + texts
    found = pieces.encode_texts(table(spark, rows), "doc_id", "text", MODEL).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want[i, tuple(ids), library.decode(ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == want


def test_pieces_small_table(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_WORDS", 2)
    encoder = pieces.ChunkEncoder(MODEL, True)
    texts = ["one two three four", "two five", "", "six one"]
    for _ in range(3):
        ids, counts = encoder.encode(texts)
        assert [list(p) for p in np.split(ids, np.cumsum(counts)[:-1])] == encoder.processor.encode(texts, add_eos=True)


def test_decoding_of_given_ids(spark):
    rows = spark.createDataFrame([(1, [1867, 28713, 2]), (2, []), (3, None)], "n int, ids array<int>")
    found = {r.n: r.decoded for r in pieces.decode_ids(rows, "ids", MODEL).collect()}
    assert found == {1: "</s", 2: "", 3: ""}


def test_pieces_empty(none):
    assert pieces.encode_texts(none, "doc_id", "text", MODEL).count() == 0


# -- language model --------------------------------------------------------------------


def test_attention_gradient_and_windows():
    rng = np.random.default_rng(0)
    vocabulary = attention.Vocabulary.from_counts(rng.integers(0, 50, 3000).astype(float))
    sizes = np.array([1, 0, 32, 33, 57, 200])
    ids = rng.integers(0, 3000, sizes.sum())
    place, inputs, owner = attention.windows(ids, sizes, 1)
    assert sorted(place[place >= 0]) == list(range(len(ids)))
    p = {k: v.astype(np.float64) for k, v in attention.first_parameters(vocabulary).items()}
    rows, wanted = vocabulary.row[inputs], vocabulary.group[ids[np.maximum(place, 0)]]
    _, grads = attention.gradient(p, rows, wanted, place >= 0)
    for name in p:
        spot = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        want = numeric(lambda q: attention.gradient(q, rows, wanted, place >= 0)[0], p, name, spot)
        assert grads[name][spot] == pytest.approx(want, rel=1e-2, abs=1e-5)


def test_attention_is_causal_and_a_distribution():
    rng = np.random.default_rng(3)
    vocabulary = attention.Vocabulary.from_counts(rng.integers(0, 50, 300).astype(float))
    p = attention.first_parameters(vocabulary)
    head = rng.integers(0, 300, 5)
    total = sum(
        math.exp(float(attention.log_probabilities(p, vocabulary, np.append(head, i), np.array([6]), 1)[0]))
        for i in range(300)
    )
    prefix = math.exp(float(attention.log_probabilities(p, vocabulary, head, np.array([5]), 1)[0]))
    assert total == pytest.approx(prefix, rel=1e-4)


def test_attention_matches_plain_softmax():
    """Scores of windows, also with logits far apart, equal those of a loop over places."""
    rng = np.random.default_rng(6)
    vocabulary = attention.Vocabulary.from_counts(rng.integers(0, 50, 3000).astype(float))
    sizes = np.array([0, 1, 31, 32, 33, 61, 150, 0])
    ids = rng.integers(0, 3000, sizes.sum())
    place, inputs, owner = attention.windows(ids, sizes, 1)
    for size in (1.0, 60.0):
        p = attention.first_parameters(vocabulary)
        p["top"] = p["top"] * np.float32(size)
        want = np.zeros(len(sizes))
        for spots, rows, text in zip(place, vocabulary.row[inputs], owner):
            x = (p["embed"][rows] + p["place"]).astype(float)
            q, k, v = np.split(x @ p["mix"], 3, axis=1)
            for i in np.flatnonzero(spots >= 0):
                weights = np.exp(k[: i + 1] @ q[i] / math.sqrt(attention.WIDTH))
                logits = (x[i] + weights @ v[: i + 1] / weights.sum() @ p["out"]) @ p["top"] + p["bias"]
                goal = ids[spots[i]]
                want[text] += logits[vocabulary.group[goal]] - np.logaddexp.reduce(logits) + vocabulary.within[goal]
        found = attention.log_probabilities(p, vocabulary, ids, sizes, 1)
        assert found == pytest.approx(want, rel=1e-4)


def test_attention_batches_share_their_arrays():
    """After the first batch none of its large arrays is allocated again."""
    rng = np.random.default_rng(7)
    p = attention.first_parameters(attention.Vocabulary.from_counts(rng.integers(0, 50, 3000).astype(float)))
    rows = rng.integers(0, attention.EMBEDDED, (128, attention.WINDOW))
    wanted, scored = rows % attention.CLASSES, np.ones(rows.shape, bool)
    room = attention.Room()
    for step in (attention.gradient, attention.class_scores):
        step(p, rows, wanted, scored, room)
        tracemalloc.start()
        step(p, rows, wanted, scored, room)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 700_000  # its logits alone have 1 MB


def test_texts_are_encoded_once(spark, texts, monkeypatch):
    """Training and scoring read the written ids; these and their counts are the library's."""
    calls, real = [], scoring.encoded_texts
    monkeypatch.setattr(scoring, "encoded_texts", lambda rows, path: calls.append(rows.columns) or real(rows, path))
    found = scoring.score_texts(table(spark, texts), MODEL).select("score").collect()
    assert len(calls) == 1 and len(found) == len(texts)
    encoder = pieces.ChunkEncoder(MODEL, end=True)
    rows = spark.createDataFrame(list(enumerate(t or "" for _, t in texts)), "n int, text string")
    encoded = real(rows, MODEL)
    kind, want = scoring.id_type(32000), Counter()
    for r in encoded.collect():
        words = (texts[r.n][1] or "").encode().translate(LOWER).split()
        ids = encoder.encode([b" ".join(words).decode()])[0]
        assert np.frombuffer(r.ids, kind).tolist() == ids.tolist()
        want.update(ids.tolist())
    counts = scoring.id_counts(encoded, 32000)
    assert {i: int(n) for i, n in enumerate(counts) if n} == want


def test_scores(spark, texts):
    found = scoring.score_texts(table(spark, texts), MODEL).collect()
    assert len(found) == len(texts)
    split = lambda t: (t or "").encode().translate(LOWER).split()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for i, t in texts:
        if not out(i):
            counts.update(split(t))
            ends += 1
    total, size = sum(counts.values()) + ends, len(counts) + 1
    want = Counter()
    for i, t in texts:
        w = split(t)
        base = sum(math.log10((counts[x] + 1) / (total + size + 1)) for x in w) + math.log10((ends + 1) / (total + size + 1))
        want[i, out(i), len(w) + 1, sum(x in counts for x in w) + 1, total, round(base, 4)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found)
    assert got == want
    assert all(r.score < 0 for r in found)


def test_rare_words_are_joined(spark, texts, monkeypatch):
    """Without a table of frequent words every word takes the joined way, to the same result."""
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4))
    whole = sorted(map(key, scoring.score_texts(table(spark, texts), MODEL).collect()))
    monkeypatch.setattr(scoring, "FREQUENT_WORDS", 0)
    assert sorted(map(key, scoring.score_texts(table(spark, texts), MODEL).collect())) == whole


def test_training_helps_on_held_out_texts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(n, " ".join(sentence(rng, 12) for _ in range(6))) for n in range(800)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")

    def held_out_score():
        return sum(r.score for r in scoring.score_texts(frame, MODEL).collect() if r.held_out)

    trained = held_out_score()
    real = scoring.learn
    monkeypatch.setattr(scoring, "learn", lambda windows, vocabulary: real(windows, vocabulary, rates=()))
    assert trained > 0.9 * held_out_score()  # scores are negative: at least a tenth nearer to 0


def test_training_windows_cover_every_id(spark):
    """All ids of a text, its end included, are targets of its windows, each once."""
    rng = random.Random(8)
    rows = [(i, " ".join(sentence(rng, 20) for _ in range(n))) for i, n in enumerate((0, 1, 3, 40, 400))] + [(9, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id AS shard_key", "coalesce(text, '') AS text")
    encoder = pieces.ChunkEncoder(MODEL, end=True)
    start = encoder.processor.bos_id()
    shared = attention.WINDOW - attention.STRIDE
    found = scoring.training_runs(frame, MODEL, 3).collect()
    lists = [np.frombuffer(r.ids, scoring.id_type(32000)) for r in found]
    windows, scored = scoring.run_windows(np.concatenate(lists), np.array([len(x) for x in lists]), np.array([r.later for r in found]))
    want, got = Counter(), Counter()
    for _, t in rows:
        seq = [start, *encoder.encode([" ".join((t or "").lower().split())])[0].tolist()]
        want.update(tuple(seq[max(0, at - shared) : at + 1]) for at in range(1, len(seq)))
    for ids, targets in zip(windows.tolist(), scored):
        got.update(tuple(ids[max(0, at + 1 - shared) : at + 2]) for at in np.nonzero(targets)[0].tolist())
    assert got == want
    assert {r.shard for r in found} == {0, 1, 2}


def test_scores_without_rows_or_training(spark, none):
    assert scoring.score_texts(none, MODEL).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scoring.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), MODEL).collect()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0
    assert row.base_score == pytest.approx(0.0) and math.isfinite(row.score)


# -- quality ---------------------------------------------------------------------------


def labelled(seed=11, n=400):
    rng = random.Random(seed)
    junk = "BUY!! now!! %%% $$$ click!! free!!".split()
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = sentence(rng, 30) if not bad else " ".join(rng.choice(junk) for _ in range(30))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_quality_on_unlabelled_documents(spark):
    rows, labels = labelled()
    rows += [(9001, None), (9002, ""), (None, rows[1][1])]
    labels += [(2, 1, 0), (2, 1, 0), (None, 1, 0), (77, None, None), (88888, 1, 0)]
    frame = table(spark, rows)
    marks = table(spark, labels, "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in resampling.keep_good(frame, marks, "doc_id", "text").select("doc_id").collect()}
    good = {i for i, _ in rows if i is not None and i < 9000 and i % 4}
    bad = {i for i, _ in rows if i is not None and i < 9000 and not i % 4}
    assert len(good - kept) <= 3 and len(bad & kept) <= 3


def test_quality_weights_by_brute_force(spark):
    rows, labels = labelled(n=60)
    good = {i for i, q, x in labels if q == 1 and x != 1}
    found = resampling.resample(
        spark.createDataFrame(rows, "doc_id bigint, text string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )
    got = {r.doc_id: r for r in found.selectExpr("row.c0 AS doc_id", "*").collect()}
    bags = {i: Counter(resampling.grams([t])[0].tolist()) for i, t in rows}
    raw, target = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if i in good:
            target.update(bag)
    m, s = resampling.BUCKETS, resampling.SMOOTHING
    for i, bag in bags.items():
        own = bag if i in good else Counter()
        n = sum(bag.values())
        weight = 0.0
        for b, times in bag.items():
            p = (target[b] - own[b] + s) / (sum(target.values()) - sum(own.values()) + s * m)
            q = (raw[b] + s) / (sum(raw.values()) + s * m)
            weight += times * math.log(p / q)
        assert got[i].log_weight == pytest.approx(weight, abs=1e-6) and got[i].n_grams == n
    keys = sorted((r.sample_key for r in got.values()), reverse=True)
    k = sum(r.kept for r in got.values())
    assert all(r.kept == (r.sample_key >= keys[k - 1] - 1e-6) for r in got.values())


@pytest.mark.parametrize("copies", [3, 40])
def test_quality_keeps_or_drops_repeated_rows_together(spark, copies, monkeypatch):
    """Every row is repeated, so that the cut lies within a group of rows that share both keys."""
    monkeypatch.setattr("sparktab.functions.ranking.GATHER_LIMIT", 20)
    rows, labels = labelled(n=60)
    rows = [(None if i == 1 else i, t) for i, t in rows] * copies
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    real = resampling.rank_cuts
    asked = []

    def within(df, group, first, second, quotas, **options):
        asked.append(quotas[0][0] // copies * copies - 1)  # one row short of a whole group
        return real(df, group, first, second, {0: asked}, **options)

    monkeypatch.setattr(resampling, "rank_cuts", within)
    found = resampling.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), marks).collect()
    sides = defaultdict(list)
    for r in found:
        sides[r.row.c0, r.row.c1].append(r.kept)
    assert len(found) == len(rows) and all(len(s) == copies and len(set(s)) == 1 for s in sides.values())
    assert sum(r.kept for r in found) == asked[0] + 1


def test_quality_without_labels_or_documents(spark, none, docs):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert resampling.keep_good(docs, marks, "doc_id", "text").count() == docs.count()
    assert resampling.keep_good(none, marks, "doc_id", "text").count() == 0


# -- pipeline and queries --------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of the tables that the pipeline reads, with planted cases."""
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(21)
    rows, labels = labelled(seed=3, n=240)
    rows = [(i, t if not i % 4 else " ".join(sentence(rng, 30) for _ in range(4)), "en", "s", 1) for i, t in rows]
    by_id = {r[0]: r[1] for r in rows}
    item = by_id[5]
    rows += [(1000 + i, by_id[i], "en", "s", 1) for i in (1, 2, 3)]  # exact copies
    rows += [(2000, by_id[6] + " Extra", None, "s", None), (3000, sentence(rng, 40) + " " + item, "en", None, 1)]
    rows += [(4000, None, None, None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_pipeline(spark, folder):
    import sentencepiece

    import corpus_pipeline

    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text or "" for r in docs.collect()}
    junk = {i for i, *_ in rows if i < 240 and i % 4 == 0}
    assert len(junk & set(kept["quality"])) <= 2 and len({i for i, *_ in rows} - junk - set(kept["quality"])) <= 2
    best = {}
    for i, t in kept["quality"].items():
        best[t] = max(best.get(t, -1), i)
    assert kept["exact"] == {i: t for t, i in best.items()}
    assert set(kept["near"]) <= set(kept["exact"]) and len(kept["near"]) >= len(kept["exact"]) - 10
    assert set(kept["near"]) - set(kept["decontaminate"]) <= {5, 3000} and 3000 not in kept["decontaminate"]
    found = corpus_pipeline.run(spark, path).collect()
    want = {}
    for i, t in kept["decontaminate"].items():
        ids = library.encode(t, add_eos=True)
        want[i] = (ids, hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in found} == want


def test_registered_queries():
    from sparktab.llm.queries import ORACLES, QUERIES

    numbers = defaultdict(list)
    for name in QUERIES:
        numbers[int(name[2:].split("_")[0])].append(name)
    assert sorted(numbers) == list(range(1, 14)) and all(len(names) == 1 for names in numbers.values())
    assert set(ORACLES) <= set(QUERIES)
