"""Each operator against a brute-force version over adversarial rows: nulls, empty and long texts, ties, repeats, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from nameflow.llm import chat, decontam, katz, langid, lines, pieces, pii, resample, sigtree, store
from nameflow.llm import text as tx
from nameflow.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECE, BYTE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VOC = [f"w{i}" for i in range(300)] + ["the", "of", "é", "日本"]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus():
    r = random.Random(4)
    base = [r.choice(VOC) for _ in range(90)]
    rows = [(i, " ".join(r.choice(VOC) for _ in range(r.randint(1, 60)))) for i in range(40)]
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(VOC)
        rows.append((100 + k, " ".join(w[: r.randint(70, 90)])))
    odd = [None, "", " \n\t ", "A b  c", "a B c", "!!! ### $$$", "x" * 5000, "é ü 日本\n\nline\nline\nx a@b.co 1.2.3.4 +1 (578) 555-6437 4918187128635271", "▁ ▁▁\u0000 <|endoftext|> 's don't"]
    rows += [(300 + i, t) for i, t in enumerate(odd)]
    rows += [(400, " ".join(r.choice(VOC) for _ in range(4000))), (0, rows[0][1])]  # a long text and a repeated row
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with the operators' own
    rows = [(i, t, "en", "s", 1, "k", 0.5) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, blob string, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_words_of_slices():
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    for most in (1, 50, 1 << 20):
        at = 0
        for part in tx.slices(pa.array(texts, pa.string()), most):
            w = part.words()
            for k in range(len(part)):
                want = SPACED.findall(low(texts[at]))
                assert [w.text(i) for i in range(w.first[k], w.first[k + 1])] == want
                at += 1
        assert at == len(texts)


def test_language(spark, docs, empty):
    r = random.Random(1)
    alphabet = {"aa": "abc", "bb": "xyz", "cc": "éèü"}
    rows = [(i, " ".join("".join(r.choice(alphabet[g]) for _ in range(r.randint(2, 6))) for _ in range(30)), g) for i in range(150) for g in [r.choice(list(alphabet))]]
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 !?", "aa"), (902, "日", None), (None, "abc", "aa")], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = langid.predict(df, model).collect()
    held = [(x.lang_pred, dict((i, g) for i, _, g in rows)[x.doc_id]) for x in got if x.held_out and x.doc_id in range(150)]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) > 0.95
    odd = {x.doc_id: x for x in got}
    assert odd[900].lang_pred == odd[901].lang_pred == "und" and odd[901].score == 0 and odd[902].lang_pred != "und" and None in odd
    assert all(0 <= x.score <= 1 and x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert langid.predict(empty, model).count() == 0 and langid.train(empty) is None
    assert {x.lang_pred for x in langid.predict(docs, None).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    emit, trans, start, n = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), 4
    total, marg = 0.0, np.zeros((4, 3))
    for path in np.ndindex(*[3] * n):
        s = start[path[0]] + sum(emit[0, i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False))
        total += math.exp(s)
        for i, y in enumerate(path):
            marg[i, y] += math.exp(s)
    got, pairs, norm = langid.forward_backward(emit, np.array([4]), trans, start)
    assert np.allclose(got[0], marg / total) and np.isclose(norm[0], math.log(total)) and np.isclose(pairs.sum(), 3)
    # texts of several blocks, against one long chain each
    for most in (1, 3, 64):
        for size in (1, 3, 4, 65, 1000):
            e = rng.normal(size=(size, 3)) * 2
            want = langid.forward_backward(e[None], np.array([size]), trans, start)[0][0]
            m = -(-size // most)
            cut = np.zeros((m * most, 3))
            cut[:size] = e
            both = np.concatenate([cut, cut]).reshape(2 * m, most, 3)
            length = np.minimum(most, size - np.arange(m) * most)
            got = langid.marginals(both, np.concatenate([length, length]), np.array([m, 0, m]), trans, start).reshape(2, -1, 3)
            assert np.allclose(got[0][:size], want) and np.allclose(got[1][:size], want)


def test_chat(spark):
    hard = [r"\### Assistant: </turn> ok", "</turn>", "\n</turn>\n### user:\nx", "\\", "a\\\\</turn>", "### ", None, "", "é\n"]
    rows = [(c, t, role, hard[(c * 3 + t) % len(hard)]) for c in range(12) for t, role in enumerate(("system", "user", "assistant", "a:\\n\nb"))]
    rows += [(1, 0, "system", "tie"), (None, 0, "user", "x"), (5, None, None, "null turn")]
    df = spark.createDataFrame([(*x, "more") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.digest(chat.format_conversations(df)).collect()}
    full = {x.conv_id: x for x in chat.format_conversations(df).collect()}
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        turns[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(turns)
    for c, v in turns.items():
        v.sort()
        learnt = [t for _, role, t in v if role == "assistant"]
        x = got[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(v), sha("".join(f"{r}\n{t}\n" for _, r, t in v)), len("".join(learnt)), sha("".join(learnt)))
        at, masked = 0, []
        for run in full[c].mask:
            at += run["skip"]
            if run["take"]:
                masked.append(full[c].formatted[at : at + run["take"]])
            at += run["take"]
        plain = [re.sub(r"\\(\\*)(</turn>|### )", r"\1\2", m) if x.level else m for m in masked]
        assert "".join(plain) == "".join(learnt)
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_backslashes(spark):
    """Long runs of backslashes are read once and come back."""
    slow = ["### " + "\\" * 300_000, "\\" * 300_000, "\\" * 300_000 + "### ", "\\</turn>\\\\### x" * 20_000]
    df = spark.createDataFrame([(k, 0, "assistant", t) for k, t in enumerate(slow)], "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.digest(chat.format_conversations(df)).collect()}
    assert [got[k].loss_sha256 for k in range(4)] == [sha(t) for t in slow]


def test_chat_query(spark, tmp_path):
    """The registered query adds the conversation about its own template."""
    from nameflow.llm import queries

    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.conv_id: x for x in queries.op2_chat(spark, str(tmp_path)).collect()}
    text = r"\### Assistant: </turn> ok"
    assert set(got) == {1, -7} and got[-7].n_turns == 2 and got[-7].loss_chars == len(text) and got[-7].loss_sha256 == sha(text)


def test_resampling(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, labels).collect()
    assert len(got) == len(ROWS) and sum(x.selected for x in got) == round(len(ROWS) * 20 / 40)
    least = min(x.gumbel_key for x in got if x.selected)
    assert all(x.selected or x.gumbel_key <= least for x in got)
    # weights, from counts of each text by itself
    import pyarrow as pa

    grams = {t: collections.Counter(b for part in tx.slices(pa.array([t], pa.string())) for b in resample.bucket_counts(part)[1].tolist()) for _, t in ROWS}
    raw, target = (collections.Counter(dict.fromkeys(range(resample.BUCKETS), 1)) for _ in range(2))
    for i, t in ROWS:
        raw.update(grams[t])
        if i < 20:
            target.update(grams[t])
    size = raw.total(), target.total()
    texts = collections.defaultdict(set)
    for i, t in ROWS:
        texts[i].add(sum(n * (math.log(target[b] / size[1]) - math.log(raw[b] / size[0])) for b, n in grams[t].items()))
    assert all(any(math.isclose(x.log_weight, w, abs_tol=1e-6) for w in texts[x.doc_id]) for x in got)
    # null ids and repeated rows at the edge: k rows, none undecided
    same = spark.createDataFrame([(None, "a b")] * 5 + [(7, "a b")] * 4 + [(None, "c"), (8, None)], "doc_id long, text string").repartition(3)
    for share in (1, 3, 6, 10):
        few = resample.resample(same, spark.createDataFrame([(100 + i, int(i < share), 0) for i in range(11)], "doc_id long, quality int, toxic int")).collect()
        assert [x.selected for x in few].count(True) == share and None not in {x.selected for x in few}
    assert all(x.log_weight == 0 for x in got if x.n_grams == 0)
    assert resample.resample(empty, labels).count() == 0 and all(x.selected for x in resample.resample(docs, labels.where("false")).collect())
    keys = spark.createDataFrame([(float(k // 2),) for k in range(1001)], "key double")
    for k in (1, 2, 500, 1000, 1001):
        v, n = resample.kth_largest(keys, k)
        want = sorted((float(j // 2) for j in range(1001)), reverse=True)
        assert v == want[k - 1] and n == k - sum(x > v for x in want)


def test_share_is_of_all_labels(spark, docs):
    """The number of selected rows does not depend on the sample that the target model is fitted on."""
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    for most in (1, 7, 160):
        assert sum(x.selected for x in resample.resample(docs, labels, max_labelled=most).collect()) == round(len(ROWS) / 4)


@pytest.mark.parametrize("chunk", [4000, 12])
def test_jaccard(spark, docs, empty, chunk, monkeypatch):
    monkeypatch.setattr(sigtree, "CHUNK", chunk)
    got = sigtree.join_components(docs.union(docs.limit(1).selectExpr("cast(null as long)", "text", "lang", "source", "n", "blob", "score")))
    sets = {}
    for i, t in ROWS:
        w = SPACED.findall(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = got.collect()
    assert len(out) == len(ROWS) + 1
    for x in out:
        if x.doc_id is None:
            assert x.component_id is None
        else:
            assert (x.n_shingles, x.component_id) == (len(sets[x.doc_id]), find(x.doc_id))
    if chunk == 12:
        assert sigtree.join_components(empty).count() == 0


@pytest.mark.parametrize("small", [2_000_000, 20])
def test_components(spark, small, monkeypatch):
    """In one task, and in distributed rounds."""
    from nameflow.llm import components as module

    monkeypatch.setattr(module, "SMALL_EDGES", small)
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(200, 299)]
    got = {x.node: x.component for x in components(spark.createDataFrame([*edges, (None, 3), (4, None)], "u long, v long").repartition(5)).collect()}
    root = list(range(300))
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == root[x] for x in range(300))


def test_pieces(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = by_id(pieces.encode_digests(docs, PIECE, ids=True))
    for i, t in ROWS:
        ids = sp.encode(t or "")
        x = got[i]
        assert np.frombuffer(x.token_ids, "<i4").tolist() == ids and x.decoded == sp.decode(ids)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    spans = by_id(pieces.encode(docs, PIECE).withColumnRenamed("id", "doc_id"))
    for i, t in ROWS:
        x = spans[i]
        assert x.ids == sp.encode(t or "") and x.begins[1:] == x.ends[:-1] and (not t or (x.begins[0] == 0 and x.ends[-1] == len(t.encode())))
        assert got[i].spans_crc32 == zlib.crc32(np.array(x.ends, "<i4").tobytes())
    assert pieces.encode_digests(empty, PIECE).count() == 0


def test_compiled_map():
    """A trie of two keys, built by hand: `a` becomes `xy`, `ab` becomes `z`."""
    import struct

    units = [0] * 512

    def leaf(at, value):
        units[at] = 0x80000000 | value

    # offsets are chosen so that the cells of labels and leaves do not meet
    units[0] = 1 << 10
    a = 1 ^ ord("a")
    units[a] = (a ^ 256) << 10 | 0x100 | ord("a")
    leaf(256, 0)
    b = 256 ^ ord("b")
    units[b] = (b ^ 300) << 10 | 0x100 | ord("b")
    leaf(300, 3)
    m = pieces.CharsMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"xy\0z\0")
    assert m.longest(b"ab", 0) == (2, b"z") and m.longest(b"ac", 0) == (1, b"xy") and m.longest(b"c", 0) is None
    model = pieces.Model(PIECE)
    model.map = m
    norm, source = model.normalise("caabé".encode())
    assert norm == "cxyzé".encode() and source.tolist() == [0, 1, 1, 2, 4, 4, 6]


def test_long_lines(spark):
    """Lines of a megabyte of navigation words, separators, symbols and repeated words neither fail nor take long."""
    rows = ["home " * 200_000, "home | about > " * 70_000, " " * 1_000_000, "#" * 1_000_000, "| " * 500_000, "word " * 200_000, "homepage " * 100_000]
    got = by_id(lines.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert [got[k].n_lines_removed for k in range(7)] == [1, 1, 0, 1, 1, 0, 0] and [got[k].n_words for k in (0, 2, 3)] == [200_000, 0, 1]
    assert got[5].n_repeat_words == 200_000


def test_columns_that_clash_with_the_rules(spark):
    text = "Plain words follow one another here and they say a thing or two."
    df = spark.createDataFrame([(1, text, "r", "g")], "doc_id long, text string, rules string, given string")
    assert lines.clean(df).collect() == df.collect() and lines.clean(df).columns == df.columns


def test_lines(docs, empty):
    got = by_id(lines.report(docs))
    for i, t in ROWS:
        t = t or ""
        w = SPACED.findall(t)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        have = [s for s in t.split("\n") if SPACED.search(s)]
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(have) - len(set(have)), len(rep), failed)
        assert not (failed and x.kept)
    assert lines.report(empty).count() == 0


def test_line_rules(spark):
    good = "Plain words follow one another here and they say a thing or two."
    other = "More of them come after those, so that the text keeps most of what it had."
    cut = ["Home | About | Contact", "home", "Copyright (c) 2020 Acme. All rights reserved.", "### ### $$$ %%% ok", "|----|----|"]
    df = spark.createDataFrame([(0, "\n".join([good, other, *cut, "", "x"])), (1, "\n".join([f"We use cookies and {x} cookies on every single page of ours." for x in ("more", "other", "further")] + ["few words are left after that, but for some ten of them"]))], "doc_id long, text string")
    kept = by_id(lines.clean(df))
    assert kept[0].text == f"{good}\n{other}\n\nx" and 1 not in kept and kept[0].__fields__ == ["doc_id", "text"]


def brute_hits(rows, items, n=8):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])] |= {str(item)} - {"None"}
    out = {}
    for i, t in rows:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for size in set(map(len, windows)):
            for k in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[k : k + size]))) is not None:
                    found |= x
                    hit |= set(range(k, k + size))
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2)
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", block)
    items = [(1, ROWS[45][1]), (2, " ".join(ROWS[3][1].split()[:9])), (10, "A b"), (11, None), (12, "w1"), (12, "the of"), (13, "..."), (None, "A b  c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontam.digest(decontam.decontaminate(docs, bench)))
    for i, want in brute_hits(ROWS, items).items():
        x = got[i]
        assert (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) == want and x.n_near_items >= x.n_items
    assert decontam.decontaminate(empty, bench).count() == 0 and {x.n_hit for x in decontam.decontaminate(docs, bench.where("false")).collect()} == {0}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d x e f g h"), (3, "h g f e d c b a x x x x"), (4, "a b c d"), (5, "e f g h")], "doc_id long, text string")
    got = by_id(decontam.digest(decontam.decontaminate(d, spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"), slop=2)))
    assert [(got[i].n_items, got[i].n_near_items) for i in (1, 2, 3, 4, 5)] == [(1, 1), (0, 1), (0, 0), (0, 0), (0, 0)]


def test_personal_data(docs, empty):
    tests = (("email", pii.EMAIL, lambda s: True), ("ip", pii.IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", pii.CARD, lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)), ("phone", pii.PHONE, lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15))
    got = by_id(pii.detect(docs))
    for i, t in ROWS:
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(tests) for m in p.finditer(t or "") if ok(m[0]))
        x = got[i]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(w[3] == k for w in want) for k in pii.KINDS]
        shown = [f"{k}:{a}:{b}" for a, _, b, k in want]
        assert x.base_sha256 == sha(",".join(shown)) and set(shown) <= set(x.spans.split(",") if x.spans else [])
    assert pii.detect(empty).count() == 0
    masked = by_id(pii.redact(docs))
    assert masked[307].text.endswith("x <email> <ip> <phone> 4918187128635271") and masked[300].text is None


def test_long_runs():
    """Patterns read runs of digits, letters and marks once, and find what the plain ones do."""
    r, plain = random.Random(9), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5000):
        t = "".join(r.choice("012..a ") for _ in range(r.randint(1, 20)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in plain.finditer(t)]
    for unit in ("7", "\u3042", "at", "(", "x", " ", "1."):
        t = (unit * 1_000_000)[:1_000_000]
        assert pii.find(t, pii.trained())[1] == pii.base_spans(t)


def test_segments_are_exact():
    """The dynamic program finds the best of all segmentations, and held-out templates come back."""
    m = pii.trained()
    for text, _ in pii.examples(25, seed=77):
        tokens, spans = m.lattice(text, 0, len(text))
        score = m.scores(spans)
        best = [0.0] + [-1e9] * len(tokens)
        for j in range(1, len(tokens) + 1):
            best[j] = max([best[j - 1] + m.outside(text, tokens[j - 1]), *(best[i] + max(score[i, k]) for i, k in spans if k == j)])
        got = m.best(text, 0, len(text))
        where = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j in spans}
        value, used = 0.0, set()
        for kind, a, b in got:
            i, j = where[a, b]
            value += score[i, j][pii.KINDS.index(kind)]
            used |= set(range(i, j))
        value += sum(m.outside(text, tokens[t]) for t in range(len(tokens)) if t not in used)
        assert math.isclose(value, best[-1], abs_tol=1e-9)
    gold = found = right = 0
    for text, want in pii.examples(200, seed=99):
        got = set(m.best(text, 0, len(text)))
        gold, found, right = gold + len(want), found + len(got), right + len(got & set(want))
    assert right > 0.95 * gold and right > 0.95 * found


def test_addresses_in_running_text():
    """Zones hold whole addresses that words obfuscate, and held-out templates come back from sentences, ends included."""
    m, r = pii.trained(), random.Random(5)
    added = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, m)[1]]
    assert added("write to jane at example dot com now") == [("email", "jane at example dot com")]
    assert added("mail jane.doe [at] example [dot] org today") == [("email", "jane.doe [at] example [dot] org")]
    assert added("mail jane7 at example dot com now") == [("email", "jane7 at example dot com")]
    assert added("mail jane at example7 dot com now") == [("email", "jane at example7 dot com")]
    assert added("reach jane(at)example(dot)com please") == [("email", "jane(at)example(dot)com")]
    assert added("call 555 1234567 now") == [("phone", "555 1234567")] and added("call 5552345678 now") == [("phone", "5552345678")]
    for t in ("he was at home. look at the dot on the map", "we met at noon, dot your i", "host 10.0.0.256 up", "order 1700000000 shipped at 12:30", "at the end of 1999 he was at sea"):
        assert added(t) == []
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvwz") for _ in range(r.randint(2, 9)))
    right = 0
    for _ in range(200):
        at, dot = r.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")))
        s = word() + r.choice(("", "." + word(), dot + word())) + at + word() + r.choice(("", dot + word())) + dot + r.choice(("com", "org", "net"))
        t = f"{word()} {word()} {s} {word()} {word()} at {word()}"
        right += added(t) == [("email", s)]
    assert right > 190
    for t in ("x" * 5000 + "1 at", "at " * 50, "7", " dot at 5 ", "a\n\nat\t\tb dot c"):
        z = list(pii.zones(t))
        assert all(0 <= a < b <= len(t) for a, b in z) and all(x[1] <= y[0] for x, y in zip(z, z[1:]))


def test_store(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BYTE)
    folder = str(tmp_path / "s")
    store.write(docs, BYTE, folder, end_id=2)
    got = sorted(map(tuple, store.digests(spark, folder).collect()))
    want, at = [], 0
    for i, t in sorted(ROWS, key=lambda x: x[0]):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    back = {x.start: x.ids for x in store.read(spark, folder).collect()}
    assert all(zlib.crc32(np.array(back[s], "<u4").tobytes()) == c for _, s, _, c in want)
    keys = spark.read.parquet(f"{folder}/objects").where("kind = 0").select("k0", "k1")
    assert keys.count() == keys.distinct().count()
    store.write(empty, BYTE, f"{folder}-none", end_id=2)
    assert store.digests(spark, f"{folder}-none").count() == 0
    # a changed payload is noticed
    bad = spark.read.parquet(f"{folder}/objects").selectExpr("kind", "k0", "k1", "n", "case when kind = 0 then concat(substring(payload, 3), substring(payload, 1, 2)) end as payload", "doc_id", "keys", "sizes")
    bad.write.parquet(f"{folder}-bad/objects")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}-bad/{part}")
    with pytest.raises(Exception, match="payload"):
        store.digests(spark, f"{folder}-bad").count()
    with pytest.raises(Exception, match="payload"):
        store.read(spark, f"{folder}-bad").count()
    # a recipe that is gone, or whose contents were swapped with another's
    recipes = spark.read.parquet(f"{folder}/recipes")
    swapped = recipes.selectExpr("part", "place", "case doc_id when 5 then 6 when 6 then 5 else doc_id end as doc_id", "start", "n_tokens", "keys", "sizes")
    for k, wrong in enumerate((recipes.where("doc_id <> 5"), swapped, recipes.where("false"))):
        wrong.write.parquet(f"{folder}-{k}/recipes")
        for part in ("objects", "manifest"):
            spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}-{k}/{part}")
        for reader in (store.digests, store.read):
            with pytest.raises(ValueError, match="manifest"):
                reader(spark, f"{folder}-{k}")
    # a chunk that is gone
    spark.read.parquet(f"{folder}/objects").where("kind = 1 or n < 100").write.parquet(f"{folder}-less/objects")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{folder}-less/{part}")
    for reader in (store.digests, store.read):
        with pytest.raises(Exception, match="not stored"):
            reader(spark, f"{folder}-less").count()


def test_store_special_tokens(spark, tmp_path):
    """Texts that quote special tokens, against the library in its default setting."""
    from tokenizers import Tokenizer

    e, r = "<|endoftext|>", random.Random(6)
    texts = [f"a {e} b", e, f"{e}{e}", f"x{e}  's", f"  {e}\n\n{e}don{e}'t", "<|endo", f"ftext|>é {e[:-1]}", None, f"日本{e}😀 {e} ", f"<{e}|>"]
    texts += ["".join(r.choice([e, "<|", "|>", " ", "a", "'s", "é", "\n", e[:5], e[5:]]) for _ in range(30)) for _ in range(40)]
    tk, folder, at = Tokenizer.from_file(BYTE), str(tmp_path / "s"), 0
    store.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), BYTE, folder, end_id=2)
    got = sorted(map(tuple, store.digests(spark, folder).collect()))
    for i, t in enumerate(texts):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        assert got[i] == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tk.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    cut = lambda a: {a[x:y].tobytes() for e in store.chunk_ends(a, np.array([0, len(a)])) for x, y in zip([0, *e[:-1]], e, strict=True)}
    a, b = cut(body), cut(np.concatenate([rng.integers(0, 50_000, 37).astype(np.uint16), body]))
    assert len(a & b) >= len(a) - 2 and all(2 * store.MAX_IDS >= len(x) for x in a)


def test_katz(spark, docs, empty):
    from pyspark.sql import functions as F

    train = F.expr("crc32(cast(doc_id as string)) % 5 <> 1")
    got = by_id(katz.score(docs, train))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    toks = [(i, [*SPACED.findall(low(t)), "</>"]) for i, t in ROWS]
    c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    known = {w for w, k in c.items() if k >= 2} - {"</>"}
    kind = lambda w: w if w in known or w == "</>" else "<rare>"
    rare_n = sum(k for w, k in c.items() if w not in known and w != "</>")
    rare_v = sum(w not in known and w != "</>" for w in c)
    uni = {w: c[w] + 0.5 for w in known} | {"</>": c["</>"] + 0.5, "<rare>": rare_n + 0.5}
    uni = {w: p / sum(uni.values()) for w, p in uni.items()}
    big = collections.Counter(p for i, ws in toks if not held(i) for p in zip(["<s>", *map(kind, ws[:-1])], map(kind, ws), strict=True))
    nr = collections.Counter(big.values())
    d = {}
    if all(nr[r] for r in range(1, 7)) and (spare := 6 * nr[6] / nr[1]) < 1:
        d = {r: ((r + 1) * nr[r + 1] / nr[r] / r - spare) / (1 - spare) for r in range(1, 6)}
    if not d or any(not 0 < x <= 1 for x in d.values()):
        d = {r: (r - 0.5) / r for r in range(1, 6)}
    follow = collections.defaultdict(dict)
    for (u, w), k in big.items():
        follow[u][w] = k
    scale, alpha = {}, {}
    for u, f in follow.items():
        total, kept = sum(f.values()), sum(k * d.get(k, 1) for k in f.values())
        scale[u] = 1 / (total + 0.5 if kept >= total else total)
        alpha[u] = (1 - kept * scale[u]) / (1 - sum(uni[w] for w in f))
        assert math.isclose(kept * scale[u] + alpha[u] * sum(p for w, p in uni.items() if w not in f), 1)
    for i, ws in toks:
        s, u = 0.0, "<s>"
        for w in ws:
            k = follow.get(u, {}).get(kind(w), 0)
            s += math.log10(k * d.get(k, 1) * scale[u]) if k else math.log10(alpha.get(u, 1) * uni[kind(w)])
            if kind(w) == "<rare>":
                s += math.log10((c[w] + 0.5) / (rare_n + 0.5 * (rare_v + 1)))
            u = kind(w)
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9) and math.isclose(x.score, s, rel_tol=1e-9)
    assert katz.score(empty, train).count() == 0


def brute_katz(rows, held, least):
    """By id: (n_known, score) where words of `least` training occurrences are types of their own."""
    toks = [(i, [*SPACED.findall(low(t)), "</>"]) for i, t in rows]
    c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
    kind = lambda w: w if w == "</>" or c[w] >= least else "<rare>"
    rare = [k for w, k in c.items() if kind(w) == "<rare>"]
    uni = {w: k + 0.5 for w, k in c.items() if kind(w) == w} | {"<rare>": sum(rare) + 0.5}
    norm = sum(uni.values())
    big = collections.Counter(p for i, ws in toks if not held(i) for p in zip(["<s>", *map(kind, ws[:-1])], map(kind, ws), strict=True))
    nr, d, follow, out = collections.Counter(big.values()), {}, collections.defaultdict(dict), {}
    if all(nr[r] for r in range(1, 7)) and (spare := 6 * nr[6] / nr[1]) < 1:
        d = {r: ((r + 1) * nr[r + 1] / nr[r] / r - spare) / (1 - spare) for r in range(1, 6)}
    if not d or any(not 0 < x <= 1 for x in d.values()):
        d = {r: (r - 0.5) / r for r in range(1, 6)}
    for (u, w), k in big.items():
        follow[u][w] = k
    scale, alpha = {}, {}
    for u, f in follow.items():
        total, kept = sum(f.values()), sum(k * d.get(k, 1) for k in f.values())
        scale[u] = 1 / (total + 0.5 if kept >= total else total)
        alpha[u] = (1 - kept * scale[u]) / (1 - sum(uni[w] for w in f) / norm)
    for i, ws in toks:
        s, u = 0.0, "<s>"
        for w in ws:
            k = follow.get(u, {}).get(kind(w), 0)
            s += math.log10(k * d.get(k, 1) * scale[u]) if k else math.log10(alpha.get(u, 1) * uni[kind(w)] / norm)
            if kind(w) == "<rare>":
                s += math.log10((c[w] + 0.5) / (sum(rare) + 0.5 * (len(rare) + 1)))
            u = kind(w)
        out[i] = sum(c[w] > 0 for w in ws), s
    return out


def test_katz_keeps_every_type(spark, docs):
    """More types than 16 bits number, and words of one training occurrence, keep their own counts."""
    from pyspark.sql import functions as F

    words = [f"t{i}" for i in range(70_000)]
    many = [(k, " ".join(words[k::7])) for k in range(7)] + [(10 + k, " ".join(words[k * 10_000 : (k + 1) * 10_000])) for k in range(7)] + [(-1, "t5 t6 t69999 new t7"), (-2, "t6 t5"), (-3, "t69990 t69991")]
    big = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    train = F.col("doc_id") >= 0
    for df, rows, least in ((big, many, 2), (docs, ROWS, 1), (docs, ROWS, 3)):
        want = brute_katz(rows, lambda i: i < 0 or (df is docs and i % 3 == 1), least)
        got = by_id(katz.score(df, train & (F.col("doc_id") % 3 != 1) if df is docs else train, least=least))
        assert got.keys() == want.keys()
        for i, (known, s) in want.items():
            assert got[i].n_known == known and math.isclose(got[i].score, s, rel_tol=1e-9)


def test_pipeline(spark, docs, tmp_path):
    """The stages, one by one, against what the operators say of the same rows."""
    import corpus_pipeline

    r = random.Random(8)
    clean = [(1000 + k, ". ".join(" ".join(r.choice(VOC) for _ in range(12)) for _ in range(5)) + ".") for k in range(12)]
    passage = [" ".join(r.choice(VOC) for _ in range(15)) for _ in range(2)]
    rows = [*clean, (2000, clean[0][1]), (2001, clean[1][1] + " " + " ".join(passage)), (2002, clean[2][1] + " mail to a.b@c.example now"), (2003, "### $$$ %%% ###"), (2004, None)]
    base = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passage)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = base
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == base.columns
        seen[name] = {x.doc_id: x.text for x in df.collect()}
    a, b, c, d = seen.values()
    assert set(a) == {i for i, _ in rows} - {2003, 2004}
    assert set(b) == set(a) - {2000, 2002} or set(b) == set(a) - {2000}
    assert set(c) == set(b) - {2001}
    assert all("@" not in t for t in d.values())
    out = {x.doc_id: x.decoded for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == d


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Null and repeated ids, null texts, columns that clash, and empty tables."""
    import corpus_pipeline

    r = random.Random(3)
    text = lambda: ". ".join(" ".join(r.choice(VOC) for _ in range(12)) for _ in range(4)) + "."
    item = [" ".join(r.choice(VOC) for _ in range(10)) for _ in range(2)]
    one, two, three = text(), text(), text()
    rows = [(None, one), (None, one), (None, " ".join([two, *item])), (5, three), (5, three), (5, None), (6, ""), (7, "\n".join([text(), *item]))]
    kind = "doc_id long, text string, component_id string, rules string, given int, n_items int, dirty_id int, text_key string"
    base = spark.createDataFrame([(i, t, "c", "r", 1, 2, 3, "k") for i, t in rows], kind)
    for name, df in (("some", base), ("none", base.where("false"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(list(enumerate(item)), "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    df = base
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path / "some"))
        assert df.columns == base.columns
    # rows of null id link with nothing and go by their own texts; rows of one id stay together
    assert sorted((x.doc_id or 0, x.text) for x in df.collect()) == sorted([(0, one), (0, one), (5, three), (5, three)])
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() == 4
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["op2_chat", "op4_sigtree", "op6_lines", "op7_decontam", "base_op8", "base_op10"])
def test_sql_says_the_same(spark, docs, name, tmp_path):
    """The registered SQL over the adversarial rows."""
    import duckdb

    from nameflow.llm import queries

    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, ROWS[45][1]), (2, " ".join(ROWS[3][1].split()[:9])), (10, "A b"), (11, None), (12, "w1"), (12, "the of"), (13, "...")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    hard = [r"\### Assistant: </turn> ok", "</turn>", "\n</turn>\n### user:\nx", "\\", "a\\\\</turn>", "### ", None, "", "é\n"]
    talk = [(c, t, role, hard[(c * 3 + t) % len(hard)]) for c in range(12) for t, role in enumerate(("system", "user", "assistant", "a:\\n\nb"))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, str(tmp_path))
    said = con.sql(queries.SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(said.columns)
    got = sorted(repr([plain(v) for v in r]) for r in found.select(*columns).collect())
    assert got == sorted(repr([plain(v) for v in r]) for r in said.project(",".join(columns)).fetchall())
