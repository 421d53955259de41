"""op4 on planted leaks; op9 against plain Python."""

import hashlib
import random

import numpy as np

from stavelake.llm import decontam, preference

random.seed(6)
COMMON = ["the", "of", "and", "to", "in", "is", "was"]


def words(n, tag):
    return [random.choice(COMMON) if random.random() < 0.4 else f"{tag}{random.randint(0, 4000)}" for _ in range(n)]


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEMS", 7)  # several blocks
    items = [(k, " ".join(words(random.randint(15, 60), f"b{k}x")) + ". the answer" + str(k) + " was given.") for k in range(20)] + [(90, None), (91, "..."), (92, "")]
    items[19] = (19, " ".join(words(420, "long")) + " Answer: forty two.")
    docs, want = [], set()
    for i in range(120):
        body = words(random.randint(0, 400), "d")
        if i % 4 == 0:
            k = i // 4 % 20
            own = items[k][1].split()
            at = random.randint(0, len(body))
            kind = i % 16
            if kind == 4:  # paraphrase: one word in three replaced, answer there
                own = [w if (j % 3 or j > len(own) - 5) else "other" for j, w in enumerate(own)]
            if kind == 8:  # a third of the item is no leak
                own = own[: len(own) // 3]
            else:
                want.add((i, k))
            body[at:at] = own
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, items[0][1].upper()), (502, items[0][1].upper()), (None, items[1][1])]
    want |= {(502, 0), (None, 1)}
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, cosine double").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    assert {r.verdict for r in got} == {"copy", "paraphrase"}
    free = frame.filter(decontam.leak_free(frame, bench)).collect()
    assert {r.doc_id for r in free} == {i for i, _ in docs} - {i for i, _ in want}
    assert decontam.leaks(frame.limit(0), bench).count() == 0
    assert decontam.leaks(frame, bench.limit(0)).count() == 0 and frame.filter(decontam.leak_free(frame, bench.limit(0))).count() == len(docs)


def test_randomised_vectors_are_those_of_the_whole_matrix(spark):
    """Counts and products of one pass over documents of several passages, against numpy on the whole matrix; and the leading
    vectors against its singular vectors."""
    base = [words(64, f"t{k}x") for k in range(12)]
    texts = [" ".join(random.choice(base)[: random.randint(1, 64)]) for _ in range(400)] + [None, "", "..."]
    vocabulary = np.unique(decontam.Words()([" ".join(base[0])])[0])
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    n, count, terms, total = decontam.gather(frame, vocabulary, 80)
    rows = []
    for t in texts:
        h = decontam.Words()([t])[0]
        rows += [h[i : i + 32] for i in range(0, len(h), 32)]
    a = np.zeros((len(rows), decontam.BUCKETS))
    for i, h in enumerate(rows):
        a[i, decontam.bucket_of(h)] = 1
    assert n == len(rows) and (count == a.sum(0)).all()
    assert terms.tolist() == [sum(v in h for h in rows) for v in vocabulary]
    assert np.allclose(total, a.T @ (a @ decontam.dense_signs(80)), rtol=1e-3, atol=1e-2)
    weights = np.log((n + 1) / (count + 1)) + 0.1
    u = decontam.leading_vectors(weights, total, 8)
    best = np.linalg.svd(a * weights, full_matrices=False, compute_uv=False)
    assert np.allclose(u.T @ u, np.eye(8), atol=1e-6) and ((a * weights @ u) ** 2).sum() > 0.97 * (best[:8] ** 2).sum()


def test_words_are_those_of_the_pattern(monkeypatch):
    texts = ["Ab c-d_e 12", None, "", "Ünïcode, Straße!", "日本語 and kana かな x", "œuvre l'été", "ÿ\xa0b", "a" * 50, "İstanbul’s", "x y " * 40]
    for piece in (1 << 20, 8):
        monkeypatch.setattr(decontam, "PIECE", piece)
        h, firsts = decontam.Words()(texts)
        one = lambda w: decontam.Words()([w])[0][0]
        assert [h[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])] == [[one(w) for w in decontam.words_of(t)] for t in texts]
    distinct = {w for t in texts for w in decontam.words_of(t)}
    assert len({one(w) for w in distinct}) == len(distinct)


def test_common_subsequence():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(100):
        a, b = random.choices("abcde", k=random.randint(1, 30)), random.choices("abcde", k=random.randint(0, 80))
        assert decontam.common(a, b) == slow(a, b)


def by_hand(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1

    def render(turns):
        out, mask = "", []
        for role, text in turns:
            out += f"<|im_start|>{role}\n"
            begin = len(out)
            out += f"{text}<|im_end|>"
            if role == "assistant":
                mask.append(f"{begin}-{len(out)}")
            out += "\n"
        return out, ",".join(mask)

    return (n, render(a[:n])[0], *render(a[n:]), *render(b[n:]))


def test_preferences(spark):
    pool = [("user", "hi"), ("assistant", "yo 🙂"), ("system", ""), ("assistant", "no\n"), ("user", "é")]
    pairs = []
    for i in range(60):
        head = random.choices(pool, k=random.randint(0, 4))
        pairs.append((i, head + random.choices(pool, k=random.randint(0, 4)), head + random.choices(pool, k=random.randint(0, 4))))
    turns = "array<struct<role:string,text:string>>"
    frame = spark.createDataFrame(pairs, f"pair_id int, chosen {turns}, rejected {turns}")
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in preference.format_preferences(frame).collect()}
    assert got == {i: by_hand(a, b) for i, a, b in pairs}


def test_conversation_pairs(spark):
    """Every conversation gives a row; branches leave at any turn, and the partner goes on from there."""
    rows = []
    for c in (3, 4, 10, 11, 30, 31, 45):
        for i in range(random.randint(2, 7)):
            rows.append((c, i, "assistant" if i % 2 else "user", random.choice(["same", f"{c}.{i} <|im_end|>", None])))
    rows += [(20, 0, "user", "only"), (21, 0, None, "x"), (50, 0, "assistant", "r"), (51, 1, "assistant", "a"), (51, 1, "assistant", "A"), (51, 0, "user", "é"), (51, 2, "user", "late")]
    rows += [(-2, 0, "assistant", "m"), (-1, 0, "assistant", "m"), (None, 0, "assistant", "r")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, k string").repartition(3)
    got = {r.pair_id: r for r in preference.preferences(frame).collect()}
    by = {}
    for c, i, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((i, role or "", (text or "").replace("<|", "< |")))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in by.items()}
    end = {c: max(i + 1 for i, t in enumerate(v) if t[0] == "assistant") for c, v in turns.items() if any(t[0] == "assistant" for t in v)}
    order = sorted(end)
    assert set(got) == set(turns) and len(order) % 2 == 1
    cuts = []
    for k, c in enumerate(order[:-1]):
        o = order[k ^ 1]
        own, other = turns[c][: end[c]], turns[o][: end[o]]
        cut = int(hashlib.md5(str(c).encode()).hexdigest()[:8], 16) % len(own)
        rejected = own[:cut] + (other[cut:] if len(other) > cut else other[-1:])
        r = got[c]
        assert (r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) == by_hand(own, rejected) and (r.partner_id, r.status) == (o, "paired")
        cuts.append(len(own) - r.prompt_turns)
    assert len(set(cuts)) > 2 and (got[-1].prompt_turns, got[-1].chosen) == (1, "")
    assert got[order[-1]].status == "unpaired" and {got[c].status for c in turns.keys() - end.keys()} == {"no_assistant"} and got[20].prompt is None
    assert preference.preferences(frame.limit(0)).count() == 0


def test_long_and_null_conversations(spark):
    long = [("user" if i % 3 else "assistant", "x" * (i % 7)) for i in range(3 * preference.BLOCK + 5)]
    turns = preference.TURNS
    pairs = [(0, long, long[:1] + [("assistant", "b")] + long[2:]), (1, None, [("assistant", None)]), (2, None, None), (3, [("user", "a")], []), (4, long[: preference.BLOCK], [])]
    frame = spark.createDataFrame(pairs, f"pair_id int, chosen {turns}, rejected {turns}")
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in preference.format_preferences(frame).collect()}
    assert got == {i: by_hand(a or [], [(r, t or "") for r, t in b or []]) for i, a, b in pairs}
