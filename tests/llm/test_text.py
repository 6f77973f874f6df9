import hashlib
import random

import pyarrow as pa
import pytest

from daywatch.llm import chat, langid, pieces, quality, toxicity
from tests.llm.frames import docs, prose

ODD = ["", "a", " a", "a  b", "\ta\nb", "a\n\nb", "é́ ﬁ　x", "<s> </s> <unk> <0x0A>", "\x00a", "a▁b", "  ",
       "▁", "\n", "\n ", " \n", "\r\n", "日本語テキスト", "🙂🙂 ok", "x" * 3000, " " * 300, "the " * 900,
       "a b", "﻿bom", "ab" * 700 + "\n" + "zz " * 20]


# ---- pieces -----------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_agenda_equals_library_text_by_text(library):
    v = pieces.Vocabulary()
    r = random.Random(1)
    alphabet = "ab the ing\n\té▁日🙂.,1"
    texts = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(500)]
    for t in texts:
        whole = v.encode_cut("▁" + t.replace(" ", "▁")) if t else ()
        assert list(whole) == library.encode(t), t


def test_encoder_cuts_equal_library(library):
    enc = pieces.Encoder(keep=50)          # a small table that is emptied often
    for t, ids in zip(ODD, enc.encode(ODD)):
        assert ids == library.encode(t), t
        assert enc.decode(ids) == (library.decode(library.encode(t)) if t else "")
    assert enc.corrected == 0


def test_both_agendas_merge_alike(library):
    import random
    v, r = pieces.Vocabulary(), random.Random(5)
    words = [pieces.MARK + "".join(r.choice("aaabcdeeinorst") for _ in range(r.randrange(1, 24)))
             for _ in range(400)] + ["", "a", "ab", "\u6f22\u5b57", pieces.MARK * 5]
    for w in words:
        assert v.merged(w) == v.merged_by_heap(w), w


def test_encode_documents(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "null id"), (3, ODD[3])]
    found = {(r.doc_id, r.decoded): r for r in pieces.encode_documents(docs(spark, rows, clash=True)).collect()}
    assert sum(1 for _ in found) == len(set(rows))
    for i, t in rows:
        ids = library.encode(t or "")
        r = found[i, library.decode(ids) if ids else ""]
        assert r.ids == ids and r.n_tokens == len(ids) and r.n_corrected == 0
    digest = {r.doc_id: r for r in pieces.encode_documents(docs(spark, rows), digest=True).collect()}
    assert digest[90].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.encode_documents(docs(spark, [])).count() == 0


# ---- chat -------------------------------------------------------------------

CHAT = [(1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "a </s> b"),
        (2, 0, "user", "[INST] x [/INST]"), (2, 1, "assistant", None), (2, 2, "tool", "</s><s> \\"),
        (3, None, "assistant", ""), (3, 5, None, "\\\\ [/INST"), (3, 5, None, "\\\\ [/INST"),
        (4, 0, "<s> odd <</ROLE>>", " </s> "), (None, 0, "user", "y" * 9000), (5, 0, "assistant", " \\"),
        (5, 1, "user", "ends with \\"), (5, 2, "user", "[/INST]"), (6, 0, "user", " [/INST]\\")]


def test_chat_turns_round_trip():
    r = random.Random(2)
    parts = list(chat.CONTROL) + ["\\", " ", "a", "\n", "é"]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "system", "tool", ""]),
                  "".join(r.choice(parts) for _ in range(r.randrange(6)))) for _ in range(3)]
        assert chat.parse(chat.render(turns)) == turns


def test_chat_plain_text_is_not_escaped():
    out, lo, hi, escaped = chat.render_turn("user", "plain [text] <b>")
    assert not escaped and out == "[INST] plain [text] <b> [/INST]" and out[lo:hi] == "plain [text] <b>"


def test_chat_digest_equals_brute_force(spark):
    df = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string")
    df = df.selectExpr("*", "'clash' AS formatted", "1 AS n_turns")
    found = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert len(found) == 7
    for conv in {c[0] for c in CHAT}:
        rows = sorted((c for c in CHAT if c[0] == conv),
                      key=lambda c: (c[1] is not None, c[1] or 0, c[2] is not None, c[2] or "", c[3] or ""))
        sha = hashlib.sha256("".join(f"{c[2] or ''}\n{c[3] or ''}\n" for c in rows).encode()).hexdigest()
        loss = "".join(c[3] or "" for c in rows if c[2] == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(rows), sha, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == len(chat.render([(c[2], c[3]) for c in rows]))
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_chat_bad_text_is_refused():
    with pytest.raises(ValueError):
        chat.parse("[INST] never closed")


# ---- language ---------------------------------------------------------------

def segmentations(s, table):
    """Every way to write s in pieces; a character that is no piece stands for itself."""
    if not s:
        yield []
    for k in range(1, len(s) + 1):
        if s[:k] in table or k == 1:
            for rest in segmentations(s[k:], table):
                yield [s[:k], *rest]


def test_word_sums_equal_all_segmentations():
    import math
    import numpy as np
    r = random.Random(5)
    table = {p: (r.random() / 9, r.random() / 9) for p in
             ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bbb", "aabb", "ababababa"]}
    m = langid.Model(["x", "y"], table)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 11))) for _ in range(60)] + ["abababababab", "é日c"]
    got, counts = m.words(words), np.array([r.randrange(1, 9) for _ in words])
    lang = np.array([r.randrange(2) for _ in words])
    want_e = {(p, x): 0.0 for p in table for x in (0, 1)}
    for w, row, n, x in zip(words, got, counts, lang):
        every = list(segmentations("▁" + w, table))
        value = [[math.prod(table.get(p, (langid.FLOOR,) * 2)[y] for p in s) for s in every] for y in (0, 1)]
        assert row.tolist() == pytest.approx([math.log(sum(v)) for v in value])
        for s, v in zip(every, value[x]):
            for p in s:
                if p in table:
                    want_e[p, x] += n * v / sum(value[x])
    e = m.expected(lang, words, counts)
    for i, p in enumerate(table):
        assert e[i].tolist() == pytest.approx([want_e[p, 0], want_e[p, 1]])


def test_long_words_are_summed_end_to_end():
    from decimal import Decimal
    r = random.Random(6)
    table = {p: (r.random() / 9, r.random() / 9) for p in
             ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab", "bbb", "aabb", "abababababababab"]}
    m = langid.Model(["x", "y"], table, keep=40)
    words = ["".join(r.choice("abc") for _ in range(n)) for n in [33, 40, 64, 65, 200, 1500, 1, 2]] + ["ab" * 400]
    got = m.words(words)
    for w, row in zip(words, got):
        s = "▁" + w
        for x in (0, 1):
            alpha = [Decimal(1)] + [Decimal(0)] * len(s)
            for i in range(1, len(s) + 1):
                if s[i - 1] not in table:
                    alpha[i] += alpha[i - 1] * Decimal(langid.FLOOR)
                for p in table:
                    if i >= len(p) and s[i - len(p):i] == p:
                        alpha[i] += alpha[i - len(p)] * Decimal(table[p][x])
            assert row[x] == pytest.approx(float(alpha[-1].ln()))
    for k in range(0, 9, 3):                   # through both word tables, in pieces of any size
        own = list(range(k, k + 3)) + [0, 1]
        assert m.text(" ".join(words[i] for i in own)).tolist() == pytest.approx(got[own].sum(axis=0).tolist())
    assert [(x.start, x.stop) for x in langid.together(["aaaa", "b", "c" * 50, "d"], 10)] == [(0, 2), (2, 3), (3, 4)]


def test_the_vocabulary_is_whole():
    pieces_ = langid.fixed_vocabulary()
    assert max(map(len, pieces_)) > 8 and len(pieces_) > 20_000
    model = langid.Model(["x"], {p: (1 / len(pieces_),) for p in pieces_})
    trie = model._tables()["trie"]
    for p in random.Random(1).sample([p for p in pieces_ if p[0] == langid.MARK and len(p) > 1], 300):
        net = trie.lattice([p[1:]])
        whole = (net.begin == 0) & (net.end == len(p))
        assert [pieces_[i] for i in net.piece[whole]] == [p]


def test_language_learns_and_answers_odd_texts(spark):
    en, de = ["the", "house", "and", "tree", "with"], ["der", "haus", "und", "baum", "mit"]
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(en if i % 2 else de) for _ in range(12)), "en" if i % 2 else "de")
            for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (103, "the tree", None),
             (104, "x" * 4000, None), (None, "der baum", "en"), (7, rows[7][1], "en")]
    df = docs(spark, rows, clash=True)
    model = langid.fit(df)
    found = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert {found[i].lang_pred for i in (100, 101, 102)} == {"und"}
    assert found[103].lang_pred == "en" and found[None].lang_pred == "de" and not found[None].held_out
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert all(0 <= r.score <= 1 for r in found.values())
    empty = docs(spark, [])
    assert langid.identify(empty, langid.fit(empty)).count() == 0
    assert langid.identify(df, langid.fit(empty)).filter("lang_pred <> 'und'").count() == 0


# ---- quality ----------------------------------------------------------------

def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_flat_forest_equals_walk_by_hand():
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.grow(x, y, trees=30, depth=3)
    assert ((f.scores(x) > 0.5) == y).mean() > 0.95
    for row in range(20):
        z = f.base
        for t in range(30):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(x[row, f.feature[t, node]] > f.cut[t, node])
            z += f.leaf[t, node - 7]
        assert z == pytest.approx(f.margin(x[row:row + 1])[0])


def test_statistics_do_not_depend_on_the_batch():
    import numpy as np
    import pyarrow as pa
    from daywatch.llm.common import text_bytes
    texts = ODD + ["Two lines.\nTwo lines.\nOther words!"]
    data, off = text_bytes(pa.array(texts))
    together = quality.statistics(data, off)
    alone = np.vstack([quality.statistics(*text_bytes(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all()
    last = dict(zip(quality.NAMES, together[-1]))
    assert last["distinct_lines"] == pytest.approx(2 / 3) and last["p."] == pytest.approx(2 / 6)


def test_quality_learns(spark):
    rows = [(i, " ".join(prose(i, 40)) + "." if i % 2 else " ".join(w + "###" for w in prose(i, 40)))
            for i in range(120)] + [(500, None), (501, ""), (None, "x"), (3, "word " * 5000)]
    marks = labels(spark, [(i, i % 2, 0) for i in range(120)] + [(500, None, None), (None, 1, 1)])
    found = {r.doc_id: r for r in quality.score_quality(docs(spark, rows, clash=True), marks).collect()}
    assert all(found[i].predicted == i % 2 for i in range(120) if i != 3)
    assert all(0 <= r.score <= 1 for r in found.values()) and len(found) == 123
    nothing = quality.score_quality(docs(spark, rows), marks.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


# ---- toxicity ---------------------------------------------------------------

def toxic_rows():
    """Rude texts often name one group, so plain fitting would blame the name."""
    r, rows, marks = random.Random(4), [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(i, 25)
        if toxic:
            words.insert(3, r.choice(["nasty", "vile"]))
            if r.random() < 0.8:
                words.insert(9, "muslims")
        elif r.random() < 0.1:
            words.insert(9, "christians")
        rows.append((i, " ".join(words)))
        marks.append((i, None, int(toxic)))
    return rows, marks


def test_counterfactual_penalty_frees_group_names(spark):
    rows, marks = toxic_rows()
    df, lab = docs(spark, rows, clash=True), labels(spark, marks)
    free = toxicity.fit(df, lab, penalty=0.0)
    fair = toxicity.fit(df, lab, penalty=10.0)
    neutral = ["many muslims read books", "many christians read books"]
    gap = lambda m: abs(m.scores(neutral)[0] - m.scores(neutral)[1])
    assert gap(fair) < 0.2 * gap(free) and fair.scores(neutral).max() < 0.5
    assert fair.scores(["what a vile thing", "nasty muslims"]).min() > 0.5


def test_toxicity_rows_and_cleaning(spark):
    rows, marks = toxic_rows()
    rows += [(900, None), (901, ""), (None, "vile"), (902, "word " * 8000 + "vile"), (0, rows[0][1])]
    df, lab = docs(spark, rows, clash=True), labels(spark, marks + [(None, 0, 1), (900, 1, None)])
    found = toxicity.score_documents(df, toxicity.fit(df, lab)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == 0
    clean = toxicity.clean_documents(df, lab)
    assert clean.columns == df.columns
    assert clean.count() == sum(r.predicted == 0 for r in found)
    none = toxicity.score_documents(df, toxicity.fit(df, lab.limit(0)))
    assert none.filter("predicted = 1").count() == 0


def test_word_chances_equal_counting():
    import itertools
    import numpy as np
    n, pos = 9, 4
    a, p = map(np.array, zip(*[(x, y) for x in range(1, 10) for y in range(max(0, x - 5), min(x, 4) + 1)]))
    chance, least = toxicity.tails(n, pos, a, p)
    for x, y, c, m in zip(a, p, chance, least):
        hits = [sum(i < pos for i in s) for s in itertools.combinations(range(n), int(x))]
        tail = lambda z: min(sum(h >= z for h in hits), sum(h <= z for h in hits)) / len(hits)
        assert c == pytest.approx(tail(y)) and m == pytest.approx(min(map(tail, set(hits))))


def test_one_rule_lets_words_in_at_every_size():
    import numpy as np

    def brute(n, pos, a, p, words, rate):
        c, m = toxicity.tails(n, pos, np.array(a), np.array(p))
        ok = [t for t in c if t * sum(w for w, x in zip(words, m) if x <= t)
              <= rate * sum(w for w, x in zip(words, c) if x <= t)]
        return [bool(ok) and x <= max(ok) for x in c]

    r = random.Random(8)
    for _ in range(200):
        n = r.randrange(2, 60)
        pos = r.randrange(1, n)
        a = [r.randrange(1, n + 1) for _ in range(12)]
        p = [r.randrange(max(0, x - (n - pos)), min(x, pos) + 1) for x in a]
        words = [r.randrange(1, 30) for _ in a]
        assert toxicity.telling(n, pos, a, p, words, 0.2).tolist() == brute(n, pos, a, p, words, 0.2)
    # one toxic word among many that are not, in a small and in a large sample
    for n, pos, a in ((60, 12, 8), (20_000, 4000, 900)):
        assert toxicity.telling(n, pos, [a, a, 1], [a, a // 5, 0], [1, 500, 9000], 0.1).tolist() == [True, False, False]


def test_training_finds_the_least_penalised_loss():
    import numpy as np
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 40)
    own = [sorted(set(r.integers(0, 6, 3).tolist()) | ({6} if t and r.random() < 0.8 else set())) for t in y]
    other = [[sorted({5 - w if w < 2 else w for w in x})] if i % 3 == 0 else [] for i, x in enumerate(own)]
    names = [f"w{i}" for i in range(7)]

    def loss(w):
        logit = lambda x: w[7] + sum(w[i] for i in x)      # noqa: E731
        fit = sum(np.log1p(np.exp(-logit(x) if t else logit(x))) for t, x in zip(y, own)) / len(y)
        moves = [(logit(x) - logit(c)) ** 2 for x, cs in zip(own, other) for c in cs]
        return fit + 0.01 / 2 * sum(v * v for v in w[:7]) + 0.5 * sum(moves) / len(moves)

    m = toxicity.train(y, own, other, names, penalty=0.5, ridge=0.01, steps=3000, rate=0.02)
    best = np.array([*(m.weights[x] for x in names), m.bias])
    slope = [(loss(best + e) - loss(best - e)) / 2e-4 for e in np.eye(8) * 1e-4]
    assert np.abs(slope).max() < 2e-3
    assert all(loss(best) <= loss(best + r.normal(size=8) * 0.05) + 1e-6 for _ in range(50))


def test_toxicity_and_quality_of_empty_tables(spark):
    none, lab = docs(spark, [], clash=True), labels(spark, [(1, 1, 1)])
    assert toxicity.score_documents(none, toxicity.fit(none, lab)).count() == 0
    assert toxicity.clean_documents(none, lab.limit(0)).count() == 0
    assert quality.score_quality(none, lab).count() == 0


def test_swap_terms_always_changes_the_term():
    for step in range(200):
        out = toxicity.swap_terms(["all", "women", "and", "jews"], step=step)
        assert out[0] == "all" and out[1] != "women" and out[3] != "jews"


def test_released_encoders_go_with_their_task():
    """The same rows, and nothing left in the worker for the stages that follow."""
    import gc
    texts = ["one two three", None, "", "one two\nfour five " * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array([t or "" for t in texts])],
                                       ["doc_id", "text"])
    pieces._ENCODERS.clear()
    released = list(pieces._batches(iter([batch]), None, 100, True, True))
    gc.collect()
    assert not pieces._ENCODERS and not any(isinstance(x, pieces.Encoder) for x in gc.get_objects())
    assert released[0].equals(list(pieces._batches(iter([batch]), None, 100, True))[0])
    assert len(pieces._ENCODERS) == 1
