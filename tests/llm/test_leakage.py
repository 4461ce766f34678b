import random

from carrel.llm.leakage import Scanner, find_leaks

R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randrange(3, 9))) for _ in range(900)]
ITEMS = [(i, " ".join(R.sample(WORDS, 90))) for i in range(5)]


def altered(text, share, seed=1):
    r = random.Random(seed)
    w = text.split()
    for k in r.sample(range(len(w)), int(len(w) * share)):
        w[k] = r.choice((w[k][:1] + "zz" + w[k][1:], "other"))
    return " ".join(w)


def documents():
    a, b = ITEMS[0][1], ITEMS[1][1]
    return [
        (1, "intro. " + " ".join(a.split()[30:55]) + " end", {0}), (2, " ".join(a.split()[30:53]), set()), (3, "x " + altered(b, 0.09) + " y", {1}), (4, altered(b, 0.5), set()),
        (5, "> " + "\n> ".join(ITEMS[2][1].upper().replace("e", "е")[k : k + 37] for k in range(0, 600, 37)), {2}), (6, "", set()), (7, None, set()), (8, a + " " + b, {0, 1}), (9, "word " * 30000, set()), (10, " ".join(ITEMS[3][1].split()[:10]), set()),
    ]


def test_cases(spark):
    docs = documents()
    d = spark.createDataFrame([(i, t, 0) for i, t, _ in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, ITEMS[0], (9, None), (None, "x")], "item_id long, source_text string")
    for block in (20_000, 2):
        rows = find_leaks(d, "doc_id", "text", items, "item_id", "source_text", block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == {(i, k) for i, _, want in docs for k in want}
    run = next(r for r in rows if r.doc_id == 1)
    assert run.words == 25 and docs[0][1][run.char_start : run.char_end].split() == ITEMS[0][1].split()[30:55]
    assert find_leaks(d.limit(0), "doc_id", "text", items, "item_id", "source_text").count() == 0
    assert find_leaks(d, "doc_id", "text", items.limit(0), "item_id", "source_text").count() == 0


def test_runs_against_brute_force():
    scanner = Scanner(ITEMS)
    r = random.Random(3)
    for _ in range(60):
        k = r.randrange(5)
        w = ITEMS[k][1].split()
        n = r.choice((12, 20, 24, 25, 26, 40))
        s = r.randrange(len(w) - n)
        text = " ".join(r.sample(WORDS, 20)) + " zzz " + " ".join(w[s : s + n]) + " zzz " + " ".join(r.sample(WORDS, 20))
        assert {x[0] for x in scanner.scan(text)} == ({k} if n >= 25 else set()), n


def fewest_changes(item, doc):
    """Word-level brute force: the fewest words changed, left out or added that make the item out of a stretch of the document."""
    row = [0] * (len(doc) + 1)
    for w in item:
        new = [row[0] + 1]
        for q in range(1, len(doc) + 1):
            new.append(min(row[q - 1] + (doc[q - 1] != w), row[q] + 1, new[q - 1] + 1))
        row = new
    return min(row)


def test_items_of_any_length_with_changed_words():
    missed = cases = false = 0
    for n in range(8, 61):
        for changes in range(n // 10 + 4):
            for seed in range(3):
                r = random.Random(n * 1000 + changes * 10 + seed)
                w = r.sample(WORDS, n)
                made = list(w)
                for k in r.sample(range(n), changes):
                    kind = r.randrange(3)
                    made[k] = "".join(r.choice("qrstuvwxyz") for _ in range(6)) if kind == 0 else made[k][:2] + "z" + made[k][2:] if kind == 1 else made[k] + " zzadded"
                doc = " ".join([*r.sample(WORDS, 15), *made, *r.sample(WORDS, 15)])
                # signs by themselves are no words
                doc = doc.replace(" ", " / ", r.randrange(60))
                got = bool(Scanner([(1, " ".join(w))]).scan(doc))
                fewest = fewest_changes(w, [x for x in doc.split() if x != "/"])
                if fewest <= 0.1 * n:
                    cases += 1
                    missed += not got
                else:
                    # a run of 25 intact words is a case of its own
                    runs = " ".join(x for x in doc.split() if x != "/")
                    run = any(" ".join(w[k : k + 25]) in runs for k in range(n - 24))
                    false += got and not run
    assert cases > 400 and missed <= 0.01 * cases and false == 0, (cases, missed, false)


def test_fields(spark):
    d = spark.createDataFrame([(1, "he asked: what are the first seven letters of it? and more"), (2, "so the answer is the letters of the alphabet in order.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What are the first seven letters of it?", "The letters of the alphabet in order"), (8, None, "")], "item_id long, question string, response string")
    rows = {(r.doc_id, r.item_id, r.field) for r in find_leaks(d, "doc_id", "text", items, "item_id", ["question", "response"]).collect()}
    assert rows == {(1, 7, "question"), (2, 7, "response")}


def test_long_words_between():
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    assert Scanner([(1, a)]).scan("x " + a.replace("zeta", "zeta " + "q" * 300) + " y") == []
