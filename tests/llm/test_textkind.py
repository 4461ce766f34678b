import random

import numpy as np

from carrel.llm import textkind as K

R = random.Random(2)
ORGANS = ["liver", "spleen", "kidney", "left lung", "heart", "stomach", "chest pain", "fever"]


def prose(n):
    return " ".join(f"The patient was seen on the ward because of {R.choice(ORGANS)} trouble and the {R.choice(ORGANS)} has been stable since then." for _ in range(n))


def table_text(sep, n=25):
    return "\n".join(sep.join(("2024-01-%02d" % (i + 1), str(R.random())[:4], str(R.randrange(90)))) for i in range(n))


def list_text(mark, n=30):
    return "\n".join(mark + R.choice(ORGANS) for _ in range(n))


CASES = [(prose(8), "prose") for _ in range(60)] + [
    (prose(6).replace(". ", ".\n"), "prose"), (prose(9).replace(".", "").upper(), "prose"), (prose(6) + "\n- " + "\n- ".join(ORGANS[:4]), "prose"), (list_text("- "), "list"), (list_text("1. "), "list"), (list_text(""), "list"), (", ".join(R.choice(ORGANS) for _ in range(60)), "list"),
    (table_text("\t"), "table"), (table_text(" | "), "table"), (table_text(","), "table"), (table_text("    "), "table"), ("xx " * 400, "junk"), ("null " * 300, "junk"), ("".join(R.choice("{}[]<>#$%^*~\\ 0OIl\n") for _ in range(900)), "junk"),
    (" ".join("".join(R.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(120)), "junk"), (" ".join("%08x" % R.getrandbits(32) for _ in range(90)), "junk"),
]


def test_verdicts(spark):
    rows = [(i, t, "k") for i, (t, _) in enumerate(CASES)] + [(900, None, "k"), (901, "", "k"), (902, " \n ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    common = spark.createDataFrame([(w,) for w in "the was on of and has been since a is because".split()], "word string")
    got = {r.doc_id: r for r in K.text_kinds(docs, "doc_id", "text", common).collect()}
    wrong = [(i, k, got[i].kind) for i, (_, k) in enumerate(CASES) if got[i].kind != k]
    assert not wrong, wrong
    assert got[900].kind is None and got[901].words == 0 and got[902].kind is None
    assert K.text_kinds(docs.limit(0), "doc_id", "text", common).count() == 0


def test_statistics_against_plain_counts():
    text = "Ab cd, ef.\nGh 12!\nlist"
    scores = K.pair_scores(np.ones((K.N_CODES, K.N_CODES)))
    stats, patterns, sizes = K.measure(text, frozenset({"ab", "gh"}), scores)
    s = dict(zip(K.STATS, stats))
    assert s["words"] == 6 and s["mean_word_length"] == sum(map(len, text.split())) / 6 and s["punct_line_share"] == 2 / 3 and s["common_share"] == 2 / 5
    assert s["symbol_share"] == sum(not c.isalnum() and not c.isspace() for c in text) / len(text)
    assert sizes.tolist() == [len(x) for x in text.split("\n")] and patterns.max() < K.N_PATTERNS
    for odd in ("x", "\n\n a \n", "😀" * 500, "a" * 5000 + "\n" + "b " * 3000, "\u2028 x"):
        _, p, n = K.measure(odd, frozenset(), scores)
        assert n.sum() == sum(len(x.strip()) for x in odd.split("\n")) and p.size == n.size


def corpus(n=400, seed=5):
    """Texts of the four kinds in many shapes, prose with hard line ends and without full stops among them."""
    global R
    R = random.Random(seed)
    out = []
    for i in range(n):
        p = prose(R.randrange(3, 12))
        if i % 4 == 0:
            words, p = p.split(), ""
            for k in range(0, len(words), 9):
                p += " ".join(words[k : k + 9]) + "\n"
        out.append((p, "prose"))
    for _ in range(n // 10):
        out += [(list_text(R.choice(("- ", "* ", "", "1. ", "[ ] ")), R.randrange(8, 40)), "list"), (R.choice((", ", "; ")).join(R.choice(ORGANS) for _ in range(R.randrange(20, 70))), "list")]
        out += [(table_text(R.choice(("\t", " | ", ",", "    ", ";")), R.randrange(6, 30)), "table")]
        out += [("".join(R.choice("{}[]<>#$%^*~\\ 0OIl\n") for _ in range(R.randrange(300, 900))), "junk"), (" ".join("".join(R.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(R.randrange(30, 120))), "junk")]
    return out


def test_em_learns_from_wrong_guesses():
    texts = corpus()
    common = frozenset("the was on of and has been since a is because".split())
    counts = np.ones(K.N_CODES * K.N_CODES)
    for t, _ in texts:
        c, _k = K._codes(t)
        counts += np.bincount(c[:-1].astype(np.int32) * K.N_CODES + c[1:], minlength=counts.size)
    scores = K.pair_scores(counts.reshape(K.N_CODES, K.N_CODES))
    units = [K.measure(t, common, scores)[1:] for t, _ in texts]
    weights = np.zeros(K.N_PATTERNS)
    for p, n in units:
        np.add.at(weights, p, n)
    known = np.flatnonzero(weights)

    def right(share, rates) -> float:
        post = K.posteriors(K.votes_of(known), share, rates)
        found = [K.KINDS[int((n @ post[np.searchsorted(known, p)]).argmax())] for p, n in units]
        return sum(f == k for f, (_, k) in zip(found, texts)) / len(texts)

    # nearly blind guesses, and guesses that take a function's levels for those of another kind
    names = list(K.FUNCTIONS)
    for power, turned in ((0.3, ()), (1.0, ("common",)), (0.5, ("odd", "repeats"))):
        wrong = [np.roll(r, 1, axis=1) if names[f] in turned else r**power / (r**power).sum(0) for f, r in enumerate(K.START)]
        before = right(np.full(4, 0.25), wrong)
        share, rates = K.learn(known, weights[known], wrong, np.full(4, 0.25))
        learnt = right(share, rates)
        assert learnt > before + 0.1 and learnt > 0.97, (before, learnt)
    # no function by itself comes near
    blind = [np.full_like(r, 1 / len(r)) for r in rates]
    alone = [right(share, [r if f == g else blind[g] for g, r in enumerate(rates)]) for f in range(len(rates))]
    assert max(alone) < learnt - 0.03, (learnt, alone)
