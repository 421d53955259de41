"""op4 on copies that white space does not set apart, and on matches in frequent words."""

import random

from stavelake.llm import decontam

random.seed(2)


def found(spark, items, docs):
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
    return {(r.doc_id, r.item_id): r.verdict for r in decontam.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}


def test_copies_in_code_and_without_spaces(spark):
    han = "".join(chr(0x4E00 + random.randint(0, 3000)) for _ in range(40))
    items = ["def foo(x): return x+1 if bar(y) else baz[z-2]*qux", f"{han[:20]}。{han[20:]}"]
    other = [f"p{i}" for i in range(300)]
    docs = [" ".join(other) + "\n**(" + items[0].replace(" ", "  ") + ")** " + " ".join(other), f"你们好{han}再见" * 1, "x+1 and " + " ".join(other)]
    assert found(spark, items, docs) == {(0, 0): "copy", (1, 1): "copy"}


def test_paraphrase_in_frequent_words(spark):
    common = [f"c{i}" for i in range(30)]
    items = [" ".join(random.sample(common, 22) + [f"r{k}x{i}" for i in range(16)]) + f". {common[0]} {common[1]} ends." for k in range(60)]
    own = items[7].split()
    docs = [" ".join(w for w in own if not w.startswith("r7") or w in ("r7x0", "r7x1")), " ".join(own[:12])]
    assert found(spark, items, docs).get((0, 7)) == "paraphrase" and (1, 7) not in found(spark, items, docs)


def test_copies_in_marks(spark):
    rest = lambda k: [f"f{random.randint(0, 4000)}" for _ in range(k)]
    item = [f"w{random.randint(0, 400)}" for _ in range(40)]
    forms = ["({})", '"{}"', "<li>{}</li>", "{}", "**{}**,"]
    docs = [" ".join([*rest(60), *(form.format(w) for w in item), *rest(60)]) for form in forms] + [" ".join([*rest(30), "-".join(item), *rest(30)]), " ".join(rest(150))]
    assert found(spark, [" ".join(item), " ".join(rest(30))], docs) == {(i, 0): "copy" for i in range(6)}


def topical():
    """Seeded, whatever ran before.  Texts of 20 topics.  Each idea of a topic has two words, and texts use one or the other."""
    random.seed(11)
    ideas = [[(f"t{t}a{i}", f"t{t}b{i}") for i in range(36)] for t in range(20)]
    say = lambda t, n: " ".join(random.choice(random.choice(ideas[t])) for _ in range(n))
    docs = [say(t, 96) for t in range(20) for _ in range(20)]
    items, other, turned = [], [], []
    for t in range(6):
        body, end = [random.choice(i) for i in random.sample(ideas[t], 30)], f"so it is ans{t} here"
        items.append(f"{' '.join(body)}. {end}.")
        swap = lambda w: w.replace("a", "*").replace("b", "a").replace("*", "b")
        other.append(say(t + 10, 64) + ". " + " ".join(swap(w) if k % 5 in (0, 2, 3) else w for k, w in enumerate(body)) + f". {end}. " + say(t + 10, 64))
        turned.append(say(t + 7, 64) + ". " + " ".join(body[20:] + body[10:20] + body[:10]) + f". {end}. " + say(t + 7, 64))
    return items, docs, other, turned


def test_other_words_of_the_same_company_need_the_singular_vectors(spark, monkeypatch):
    items, docs, other, turned = topical()
    got = found(spark, items, docs + other + turned)
    n = len(docs)
    assert got == {(n + k, k % 6): "paraphrase" for k in range(12)}
    monkeypatch.setattr(decontam, "RANK", 0)
    assert found(spark, items, docs + other + turned) == {(n + 6 + k, k): "paraphrase" for k in range(6)}


def test_against_all_documents_and_items(spark, monkeypatch):
    """Every stretch of every document against every item by LCS alone: nothing that copy and paraphrase need is lost."""
    monkeypatch.setattr(decontam, "ITEMS", 5)
    monkeypatch.setattr(decontam, "KEEP", 1)  # blocks are read again
    monkeypatch.setattr(decontam, "SEGMENT", 256)
    common = [f"c{i}" for i in range(40)]
    word = lambda: random.choice(common) if random.random() < 0.5 else f"r{random.randint(0, 900)}"
    items = [" ".join(word() for _ in range(random.randint(12, 70))) + f". ends in {word()} {word()} x{k}." for k in range(17)]
    docs = []
    for i in range(150):
        body, own = [word() for _ in range(random.choice([0, 20, 200, 1500]))], items[i % 17].split()
        share = random.choice([0.3, 0.5, 0.62, 0.68, 0.72, 0.9, 1.0])
        cut = len(own) - 5
        own = [w if random.random() < share or (j >= cut and i % 3) else word() for j, w in enumerate(own)]
        at = random.randint(0, len(body))
        docs.append(" ".join(body[:at] + own + body[at:]))

    def by_hand():
        out = {}
        for i, d in enumerate(docs):
            words = decontam.words_of(d)
            for k, t in enumerate(items):
                own, end = decontam.words_of(t), decontam.words_of(decontam.last_part(t))
                masks = decontam.masks_of(own)
                for at in range(0, len(words), 16):
                    near = words[max(0, at - len(own)) : at + 16 + 2 * len(own)]
                    share = decontam.common(own, near, masks) / len(own)
                    if share >= 0.7 or share >= 0.6 and decontam.common(end, near) >= 0.8 * len(end):
                        out[i, k] = "copy" if share >= 0.7 else out.get((i, k), "paraphrase")
        return out

    want, got = by_hand(), found(spark, items, docs)
    assert len(want) > 80 and {p: v for p, v in got.items() if p in want} == want
    assert all(v == "paraphrase" and p[0] % 17 == p[1] for p, v in got.items() if p not in want)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    free = frame.filter(decontam.leak_free(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")))
    assert {r.doc_id for r in free.collect()} == set(range(len(docs))) - {i for i, _ in got}
