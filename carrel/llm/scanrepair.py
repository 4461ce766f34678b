"""Problem 4: text of scanned pages repaired into continuous paragraphs.

Headers and footers are found by fuzzy repetition of lines at page edges (letters that scanners confuse are folded to one
form, numbers to one mark), page numbers by their sequence over the pages. Then lines are joined: a word broken at a line's
end is written as the corpus vocabulary has it, whole or with its own hyphen, and a word that the clean texts do not know is
replaced by the best known word it could be a misreading of.

Corpus counts (words, edge lines) cover all documents and are shuffled after partial sums; the words of a document meet the
vocabulary in a join. Only the most frequent words, at most `most_known`, travel to the tasks, to skip words that need no look.

Defined results: null or empty texts and rows without an OCR engine have no case; pages null: a form feed starts a page; null
entries or null texts among pages fall back to that too; repeated rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.session import cut, table

# ---- fixed values: what scanners confuse --------------------------------------------------------------------------
#: (as read, what it may be)
MISREADINGS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("c", "e"), ("f", "t"), ("b", "h"), ("I", "l"), ("|", "l"), ("l", "i"), ("@", "a"), ("$", "s"), ("!", "l"), ("!", "i"), ("€", "e"), ("3", "e"), ("4", "a"), ("7", "t"), ("ri", "n"),
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("6", "b"), ("q", "g"), ("o", "c"), ("n", "u"), ("u", "n"), ("h", "b"), ("li", "h"),
]
NUMBER_LETTERS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2"})
#: Pairs and letters of the fold under which misread copies of a line are equal.
FOLD_PAIRS = [("ﬁ", "fi"), ("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d")]
FOLD_LETTERS = str.maketrans({"@": "a", "0": "o", "1": "l", "i": "l", "|": "l", "5": "s", "9": "g", "8": "b", "h": "b", "c": "e", "f": "t"})
ROMAN = re.compile(r"x{0,3}(?:ix|iv|v?i{0,3})")
EDGE_LINES = 3
RARER = 20
HYPHENS = "-‐‑¬­"
PUNCT = ".,;:()"


def line_key(line: str) -> str:
    """Fuzzy form of a line: case, spacing, confused letters and numbers do not matter."""
    s = re.sub(r"\s*(?:\W|\s)?\s{2,}\W*[\divxlOIS]{1,5}\W*$", "", line.strip())  # a page number behind a wide gap
    s = s.lower()
    for a, b in FOLD_PAIRS:
        s = s.replace(a, b)
    s = re.sub(r"\b\d[\dolsb]*\b", "#", s).translate(FOLD_LETTERS)
    return re.sub(r"[\s#]+", " ", s).strip()


def line_segments(line: str) -> list[str]:
    """line_key of the parts of a line, split where headers join a house, an office and a phrase."""
    s = re.sub(r"\s{2,}\W*[\divxlOIS]{1,5}\W*$", "", line.strip())
    return [k for k in dict.fromkeys(line_key(p) for p in re.split(r"\s*[|/:,]\s*|\s+[-–]\s+|\s+and\s+|\s{3,}", s)) if k]


# Page numbers: fixed forms, tried on the line as it stands with misread digits read as digits.
_DIGITS = r"[\dOolISB]{1,4}"
_PAGE_FORMS = re.compile(
    rf"(?:[-–—~]+\s*(?P<a>{_DIGITS})\s*[-–—~]+|\[\s*(?P<b>{_DIGITS})\s*\]|\(\s*(?P<c>{_DIGITS})\s*\)|(?:p[.,]|s[.,]|p[ao]g[ec]\.?|s[ec][il1]t[ec]|blatt|folio)\s*(?P<d>{_DIGITS})"
    rf"(?:\s*(?:of|0f|von|v0n|/|de|sur)\s*{_DIGITS})?|(?P<e>{_DIGITS})\s*(?:/|of|von|de|sur)\s*{_DIGITS})\s*[.]?",
    re.I,
)
_BARE = re.compile(rf"{_DIGITS}")


def _number(text: str) -> int | None:
    t = text.translate(NUMBER_LETTERS)
    return int(t) if t.isdigit() else None


_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10}


def _roman(text: str) -> int | None:
    t = text.lower().replace("l", "i").replace("1", "i")
    if not t or not ROMAN.fullmatch(t):
        return None
    total = 0
    for a, b in zip(t, t[1:] + " "):
        v = _ROMAN_VALUES[a]
        total += -v if _ROMAN_VALUES.get(b, 0) > v else v
    return total


def page_mark(line: str) -> tuple[str, int] | None:
    """('form', n) for a line that can only be a page number, ('bare', n) for a number alone, ('roman', n) for i, ii, iv."""
    s = line.strip()
    if m := _PAGE_FORMS.fullmatch(s):
        n = next((_number(g) for g in m.groups() if g), None)
        return ("form", n if n is not None else -1)
    if _BARE.fullmatch(s) and any(c.isdigit() or c in "lO" for c in s) and (n := _number(s)) is not None:
        return ("bare", n)
    if (n := _roman(s)) is not None:
        return ("roman", n)
    return None


def page_lines(text: str, pages) -> list[list[int]]:
    """0-based line numbers of each page."""
    lines = text.split("\n")
    if "\f" in text:
        out: list[list[int]] = [[]]
        for k, line in enumerate(lines):
            if "\f" in line:
                out.append([])
            out[-1].append(k)
        return out
    if pages is not None and len(pages) > 1 and all(p is not None and p["text"] is not None for p in pages):
        if "\n\n".join(p["text"] for p in pages) == text:
            out, at = [], 0
            for p in pages:
                n = p["text"].count("\n") + 1
                out.append(list(range(at, at + n)))
                at += n + 1
            return out
    return [list(range(len(lines)))]


def page_edges(text: str, pages, edge_lines: int = EDGE_LINES) -> list[tuple[int, int, int, str, str]]:
    """(page, line, place, line text, body): place 1, 2, ... from the top, -1, -2, ... from the bottom, edge_lines of each; blank lines do not count.

    body is a line two places further in than the edge, which tells copies of a page from pages that only share a header.
    """
    lines = text.split("\n")
    out = []
    for page, numbers in enumerate(page_lines(text, pages)):
        full = [k for k in numbers if lines[k].strip()]
        seen = set()
        for place in range(1, edge_lines + 1):
            for k, p in ((place - 1, place), (len(full) - place, -place)):
                if 0 <= k < len(full) and full[k] not in seen:
                    seen.add(full[k])
                    deep = edge_lines + 1 if p > 0 else len(full) - edge_lines - 2
                    out.append((page, full[k], p, lines[full[k]].strip(), lines[full[min(max(deep, 0), len(full) - 1)]].strip()))
    return out


# ---- corpus counts ------------------------------------------------------------------------------------------------
def word_key(token: str) -> str:
    """Vocabulary key of a token: lower case, without surrounding punctuation, a leading number as '#'."""
    return re.sub(r"^\d+-", "#-", token.strip(PUNCT).lower())


_TOKEN = re.compile(r"\S+")


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, clean, scanned, clean_texts): how often each word occurs in rows that never were on paper, in different scanned
    texts, and in different texts that never were on paper.

    Copies of a scan under other ids count once, or their misread words would be as common as right ones. The parts of a word
    broken at a line's end do not count.
    """

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            seen: dict[str, Counter] = {"clean": Counter(), "scanned": Counter(), "clean_texts": Counter()}
            for text, scanned, copies in zip(pdf["text"], pdf["scanned"], pdf["copies"]):
                if scanned:
                    text = re.sub(rf"\S+[{HYPHENS}]\s*\n\s*\S+", " ", text)
                for w, n in Counter(_TOKEN.findall(text)).items():
                    key = word_key(w)
                    if scanned:
                        seen["scanned"][key] += n
                    else:
                        seen["clean"][key] += n * copies
                        seen["clean_texts"][key] += n
            words = sorted(set(seen["clean"]) | set(seen["scanned"]))
            yield pd.DataFrame({"word": words} | {k: [c[w] for w in words] for k, c in seen.items()}, columns=["word", "clean", "scanned", "clean_texts"])

    texts = docs.groupBy("scanned", F.md5("text").alias("digest")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    counted = texts.select("text", "scanned", "copies").mapInPandas(count, "word string, clean bigint, scanned bigint, clean_texts bigint")
    return counted.where("word <> ''").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("clean", "scanned", "clean_texts")])


def edge_rows(scans: DataFrame, edge_lines: int = EDGE_LINES) -> DataFrame:
    """(doc, page, line, place, key, mark, number, inner) of all edge lines; inner lines come as key counts only (doc null)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            inner: Counter = Counter()
            for doc, text, pages in zip(pdf["doc"], pdf["text"], pdf["pages"]):
                edges = page_edges(text, pages, edge_lines)
                at = {e[1] for e in edges}
                for page, line, place, s, body in edges:
                    mark = page_mark(s)
                    rows.append((doc, page, line, place, line_key(s), line_segments(s), mark[0] if mark else None, mark[1] if mark else None, 0, body))
                for k, s in enumerate(text.split("\n")):
                    if k not in at and s:
                        inner.update(line_segments(s))
            rows += [(None, None, None, None, key, None, None, None, n, None) for key, n in inner.items()]
            out = pd.DataFrame(rows, columns=["doc", "page", "line", "place", "key", "segments", "mark", "number", "inner", "body"])
            for c in ("page", "line", "place", "number"):
                out[c] = out[c].astype("Int64")
            yield out

    return scans.select("doc", "text", "pages").mapInPandas(run, "doc string, page bigint, line bigint, place bigint, key string, segments array<string>, mark string, number bigint, inner bigint, body string")


def furniture_lines(scans: DataFrame, edge_lines: int = EDGE_LINES) -> DataFrame:
    """(doc, lines): the 0-based numbers of the lines that are furniture."""
    rows = cut(edge_rows(scans, edge_lines))
    edges = rows.where("doc IS NOT NULL AND mark IS NULL AND key <> ''")
    # at the edges of how many different pages each part stands, and how often inside pages; two partial sums, so that one part is no hot spot
    parts = edges.select("doc", "page", "line", F.xxhash64("body").alias("body"), F.explode("segments").alias("part"))
    # copies of a page have the same line further in and count once
    known = parts.groupBy("part", "body").agg(F.count("*").alias("n")).groupBy("part").agg(F.count("*").alias("docs"), F.sum("n").alias("at_edge"))
    inside = rows.where("doc IS NULL").groupBy(F.col("key").alias("part")).agg(F.sum("inner").alias("inside"))
    # also a part that stands at several pages' edges of one document must hardly occur inside pages
    counts = known.join(inside, "part", "left").where("at_edge >= 5 * coalesce(inside, 0)").select("part", "docs")
    # (salted: one part may stand in a third of all lines)
    salts = 8
    salted = counts.select("part", "docs", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    looked = parts.withColumn("salt", F.pmod(F.xxhash64("doc", "line"), F.lit(salts)).cast("int")).join(salted, ["part", "salt"], "left")
    lines = looked.groupBy("doc", "page", "line").agg(F.min(F.coalesce("docs", F.lit(0))).alias("docs"))
    same = edges.groupBy("doc", "key").agg(F.countDistinct("page").alias("pages"))
    judged = (
        rows.where("doc IS NOT NULL").join(lines, ["doc", "page", "line"], "left").join(same, ["doc", "key"], "left")
        .select("doc", "page", "line", "place", "mark", "number",
                # a line that ends a sentence or a clause is one only if it stands on most pages
                F.when(F.col("key").rlike("[.!?,;]$"), (F.col("pages") >= 3) & (F.col("docs") >= 1)).otherwise((F.col("docs") >= 3) | ((F.col("pages") >= 2) & (F.col("docs") >= 1))).alias("repeated"))
    )
    by_doc = judged.groupBy("doc").agg(F.collect_list(F.struct("page", "line", "place", "mark", "number", "repeated")).alias("edges"))

    def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc": pdf["doc"], "lines": [decide_edges(list(e)) for e in pdf["edges"]]})

    return by_doc.mapInPandas(decide, "doc string, lines array<bigint>")


def decide_edges(edges: list) -> list[int]:
    """The furniture among the edge lines of one document: from each page edge inwards, while lines repeat or number the pages."""
    offsets: Counter = Counter()
    for e in edges:
        if e["mark"] in ("bare", "roman"):
            offsets[(e["mark"], e["number"] - e["page"])] += 1
    n_pages = len({e["page"] for e in edges})
    # a number alone counts only in sequence with the pages; on a single page, as its first
    steady = {k for k, n in offsets.items() if n >= 2 or k[1] == 1 or (n_pages == 1 and k[0] == "roman")}
    out = []
    for page in {e["page"] for e in edges}:
        for sign in (1, -1):
            for e in sorted((e for e in edges if e["page"] == page and e["place"] * sign > 0), key=lambda e: e["place"] * sign):
                mark = e["mark"]
                numbered = mark == "form" or (mark in ("bare", "roman") and (mark, e["number"] - page) in steady)
                if not (numbered or (mark is None and e["repeated"])):
                    break
                out.append(e["line"])
    return sorted(out)


# ---- words --------------------------------------------------------------------------------------------------------
def fixed_number(token: str) -> str | None:
    """'l.6' -> '1.6': a number with letters read for digits, or None."""
    m = re.fullmatch(r"([\dOolISBZ.,/%x+-]*?)(-[a-zäöüß-]{3,}|%|mg|mm|cm)?", token)
    if not m or not m[1] or not re.search(r"[OolISBZ]", m[1]):
        return None
    digits = len(re.findall(r"\d", m[1]))
    letters = len(re.findall(r"[OolISBZ]", m[1]))
    fixed = m[1].translate(NUMBER_LETTERS)
    if not re.fullmatch(r"[+-]?\d+(?:[.,/x-]\d+)*", fixed) or digits == 0 and not (letters >= 2 and re.search(r"[.,/]", m[1]) or m[1] in ("lO", "lS", "lB", "SO", "BO")):
        return None
    return fixed + (m[2] or "")


MOST_CHANGES = 3
#: Tokens with more places for a change than this meet the vocabulary by their strokes.
MOST_PLACES = 24


def change_places(token: str) -> int:
    """At how many places a token may hold a misreading."""
    return sum(token.count(read) for read, _ in MISREADINGS)


def readings(token: str, most: int = MOST_CHANGES) -> dict[str, int]:
    """What a token of few places may be a misreading of -> number of changes."""
    out: dict[str, int] = {}
    layer = {token}
    for cost in range(1, most + 1):
        nxt = set()
        for s in layer:
            for read, right in MISREADINGS:
                at = s.find(read)
                while at >= 0:
                    new = s[:at] + (right.upper() if s[:1].isupper() and s.isupper() else right) + s[at + len(read) :]
                    if new != token and new not in out:
                        nxt.add(new)
                    at = s.find(read, at + 1)
                if s.count(read) > 1:  # the same letter misread throughout
                    new = s.replace(read, right)
                    if new not in out:
                        nxt.add(new)
        for s in nxt:
            out.setdefault(s, cost)
        layer = nxt
    return out


# Strokes that scanners see in letters; a misreading of MISREADINGS leaves them as they are.
_STROKES = {"ii": "hb86un", "iii": "m", "ci": "d", "vv": "w", "i": "li1|!tf7r", "c": "ceo03€", "a": "a@4", "s": "s5$", "g": "g9q"}
STROKES = str.maketrans({c: k for k, letters in _STROKES.items() for c in letters} | {"ﬁ": "ii", "ﬂ": "ii"})


def stroke_key(word: str) -> str:
    """A form that a word and its misreadings share, of any length."""
    return word.lower().translate(STROKES)


_RULES: dict[str, list[tuple[str, str]]] = {}
for _read, _right in MISREADINGS:
    _RULES.setdefault(_read[0].lower(), []).append((_read.lower(), _right))


def misread_cost(token: str, word: str, most: int = MOST_CHANGES) -> int | None:
    """The fewest changes that make the word of the token, the same letter misread throughout counting once; None beyond most."""
    token = token.lower()
    #: (places in token and word) -> sets of rules with which they can be reached
    layers: dict[tuple[int, int], set[frozenset]] = {(0, 0): {frozenset()}}
    for i in range(len(token)):
        for at in [k for k in layers if k[0] == i]:
            j, used = at[1], layers.pop(at)
            if word[j : j + 1] == token[i]:
                layers.setdefault((i + 1, j + 1), set()).update(used)
            for read, right in _RULES.get(token[i], ()):
                if token.startswith(read, i) and word.startswith(right, j):
                    more = {u | {(read, right)} for u in used}
                    layers.setdefault((i + len(read), j + len(right)), set()).update(u for u in more if len(u) <= most)
        layers = {k: v for k, v in layers.items() if v}
    ends = layers.get((len(token), len(word)))
    return min(map(len, ends)) if ends else None


def cased_as(word: str, token: str) -> str:
    """The word with the capitals of the token."""
    return word.upper() if token.isupper() and len(token) > 1 else word[:1].upper() + word[1:] if token[:1].isupper() else word


def line_cases(text: str, furniture: set[int], known: frozenset[str]) -> list[tuple[int, str, str, str]]:
    """(line, kind, left, right): 'hyphen' with the two parts of a broken word, 'word' with a token the known words lack,
    'number' with its repair at the right."""
    lines = text.split("\n")
    out = []
    body = [k for k in range(len(lines)) if k not in furniture and lines[k].strip()]
    skip_first: set[int] = set()
    for i, k in enumerate(body):
        tokens = _TOKEN.findall(lines[k])
        if not tokens:
            continue
        first, last = 0, len(tokens)
        if k in skip_first:
            first = 1
        end = tokens[-1]
        if i + 1 < len(body) and len(end) >= 2 and end[-1] in HYPHENS and end[-2].isalnum() and len(tokens) > first:
            nxt = _TOKEN.findall(lines[body[i + 1]])
            # a plain dash goes on in small letters or digits
            if nxt and nxt[0][0].isalnum():
                out.append((k, "hyphen", end.lstrip(PUNCT)[:-1], nxt[0].rstrip(PUNCT)))
                skip_first.add(body[i + 1])
                last -= 1
        for j in range(first, last):
            word = tokens[j].strip(PUNCT)
            if not word:
                continue
            if (fixed := fixed_number(word)) and fixed != word:
                out.append((k, "number", word, fixed))
            elif word_key(word) not in known and re.search(r"[^\W\d_]", word):
                start = j == 0 or tokens[j - 1][-1:] in ".!?"
                out.append((k, "word", word, "^" if start else ""))
    return out


def damage(docs: DataFrame, most_known: int = 100_000, edge_lines: int = EDGE_LINES, most_changes: int = MOST_CHANGES) -> DataFrame:
    """(doc, loaded_id, line, damage, found, repaired, left, right) of all damaged lines; line is 0-based.

    docs: loaded_id, text, pages, ocr_engine_used. edge_lines: lines of a header or a footer at most; most_changes: different
    misreadings in one word at most.
    """
    one = docs.select(F.col("loaded_id").cast("bigint").alias("loaded_id"), "text", "pages", F.col("ocr_engine_used").isNotNull().alias("scanned")).where("loaded_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    one = one.withColumn("doc", F.concat_ws("-", "loaded_id", F.hex(F.xxhash64("text", F.to_json("pages"))))).dropDuplicates(["doc", "scanned"])
    words = cut(word_counts(one))
    # at most most_known words; they only spare the join words that are surely right
    known = frozenset(r[0] for r in words.where("clean >= 3").orderBy(F.desc("clean"), "word").limit(most_known).select("word").collect())
    scans = one.where("scanned")
    furniture = cut(furniture_lines(scans, edge_lines))
    rows = scans.select("doc", "loaded_id", "text").join(furniture, "doc", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for doc, i, text, lines in zip(pdf["doc"], pdf["loaded_id"], pdf["text"], pdf["lines"]):
                gone = set() if lines is None else set(lines)
                out += [(doc, i, line, "furniture", "", "") for line in sorted(gone)]
                out += [(doc, i, *case) for case in line_cases(text, gone, known)]
            yield pd.DataFrame(out, columns=["doc", "loaded_id", "line", "kind", "left", "right"])

    cases = cut(rows.mapInPandas(run, "doc string, loaded_id bigint, line bigint, kind string, left string, right string"))
    plain = cases.where("kind IN ('furniture', 'number')").select(
        "doc", "loaded_id", "line", F.when(F.col("kind") == "number", "misread").otherwise("furniture").alias("damage"), "left", "right",
        F.when(F.col("kind") == "number", F.col("right")).otherwise("").alias("repaired"),
    )
    open_ = cases.where("kind IN ('hyphen', 'word')")
    forms = open_.select("kind", "left", "right").distinct()

    def propose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for kind, left, right in zip(pdf["kind"], pdf["left"], pdf["right"]):
                if kind == "hyphen":
                    joined = left + right
                    out += [(kind, left, right, joined, word_key(joined), 0), (kind, left, right, f"{left}-{right}", word_key(f"{left}-{right}"), 0)]
                    if change_places(joined) <= MOST_PLACES:
                        out += [(kind, left, right, w, word_key(w), n) for w, n in readings(joined, most_changes - 1).items()]
                else:
                    out.append((kind, left, right, left, word_key(left), 0))
                    for w, n in readings(left, most_changes).items() if change_places(left) <= MOST_PLACES else ():
                        new = w[0].upper() + w[1:] if right == "^" and not left[0].isalpha() and w[0].isalpha() else w
                        out.append((kind, left, right, new, word_key(new), n))
            yield pd.DataFrame(out, columns=["kind", "left", "right", "form", "word", "cost"])

    proposed = forms.mapInPandas(propose, "kind string, left string, right string, form string, word string, cost int")
    proposed = proposed.unionByName(_by_strokes(forms, words, most_changes))
    counted = proposed.join(words, "word").groupBy("kind", "left", "right").agg(
        # the own count of an unknown word, which a repair must clearly exceed
        F.max(F.when(F.col("cost") == 0, F.col("clean_texts"))).alias("own_clean"), F.max(F.when(F.col("cost") == 0, F.col("scanned"))).alias("own_scanned"),
        F.max(F.when(F.col("cost") == 0, F.struct(F.col("clean") + F.col("scanned"), "form"))).alias("as_is"),
        F.max(F.when(F.col("cost") > 0, F.struct(-F.col("cost"), F.col("clean") + F.col("scanned"), "form"))).alias("nearest"),
        F.max(F.when(F.col("cost") > 0, F.struct(F.col("clean") + F.col("scanned"), -F.col("cost"), "form"))).alias("commonest"),
    )
    own_clean, own_scanned = F.coalesce("own_clean", F.lit(0)), F.coalesce("own_scanned", F.lit(0))
    total = own_clean + own_scanned
    enough = lambda n: (n >= 3) & (n >= 5 * total)
    near, common = F.col("nearest"), F.col("commonest")
    repair = F.when(enough(near["col2"]), near["form"]).when(enough(common["col1"]), common["form"])
    # a form is a word of its own unless it is RARER times rarer in clean texts than in scanned ones, both as shares of all words
    sums = words.agg(F.coalesce(F.sum("clean_texts"), F.lit(0)).alias("all_clean"), F.coalesce(F.sum("scanned"), F.lit(0)).alias("all_scanned"))
    misread = own_clean.cast("double") * F.col("all_scanned") * RARER <= own_scanned.cast("double") * F.col("all_clean")
    chosen = counted.crossJoin(F.broadcast(sums)).select(
        "kind", "left", "right",
        F.when(F.col("kind") == "hyphen", F.when(F.col("as_is").isNotNull(), F.col("as_is.form")).otherwise(repair)).when((own_clean == 0) | misread, repair).alias("best"),
    )
    settled = open_.join(chosen, ["kind", "left", "right"], "left").select(
        "doc", "loaded_id", "line", F.when(F.col("kind") == "hyphen", "hyphen").otherwise("misread").alias("damage"), "left", "right",
        F.when(F.col("kind") == "hyphen", F.coalesce("best", F.concat("left", "right"))).otherwise(F.col("best")).alias("repaired"),
    )
    return plain.unionByName(settled.where(F.col("repaired").isNotNull()))


def _by_strokes(forms: DataFrame, words: DataFrame, most_changes: int) -> DataFrame:
    """The proposals for words with more than MOST_PLACES places for a change: known words of the same strokes."""

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for kind, left, right in zip(pdf["kind"], pdf["left"], pdf["right"]):
                token = left + right if kind == "hyphen" else left
                if change_places(token) > MOST_PLACES:
                    rows.append((kind, left, right, token, stroke_key(token)))
            yield pd.DataFrame(rows, columns=["kind", "left", "right", "token", "strokes"])

    def known(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a known word has at least half the letters of such a token, each with a stroke
        for pdf in parts:
            held = pdf[pdf["word"].str.len() * 4 >= MOST_PLACES]
            yield pd.DataFrame({"word": held["word"], "strokes": held["word"].map(stroke_key)}, columns=["word", "strokes"])

    def cost(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for kind, left, right, token, word in zip(pdf["kind"], pdf["left"], pdf["right"], pdf["token"], pdf["word"]):
                n = misread_cost(token, word, most_changes - (kind == "hyphen"))
                if n:
                    rows.append((kind, left, right, cased_as(word, token), word, n))
            yield pd.DataFrame(rows, columns=["kind", "left", "right", "form", "word", "cost"])

    long = forms.mapInPandas(keys, "kind string, left string, right string, token string, strokes string")
    meet = long.join(words.select("word").mapInPandas(known, "word string, strokes string"), "strokes")
    return meet.select("kind", "left", "right", "token", "word").mapInPandas(cost, "kind string, left string, right string, form string, word string, cost int")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = damage(table(spark, sf_dir, "loaded_document"))
    return out.select("loaded_id", (F.col("line") + 1).alias("line_no"), "damage", "repaired").distinct()


def repaired_texts(docs: DataFrame) -> DataFrame:
    """(loaded_id, text): continuous paragraphs of every scanned text."""
    one = docs.where("ocr_engine_used IS NOT NULL AND text IS NOT NULL AND text <> '' AND loaded_id IS NOT NULL")
    keyed = one.select(F.col("loaded_id").cast("bigint").alias("loaded_id"), "text", F.concat_ws("-", F.col("loaded_id").cast("bigint"), F.hex(F.xxhash64("text", F.to_json("pages")))).alias("doc")).dropDuplicates(["doc"])
    repairs = damage(docs).groupBy("doc").agg(F.collect_list(F.struct("line", "damage", "left", "right", "repaired")).alias("repairs"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [join_paragraphs(t, [] if r is None else list(r)) for t, r in zip(pdf["text"], pdf["repairs"])]
            yield pd.DataFrame({"loaded_id": pdf["loaded_id"], "text": texts})

    return keyed.join(repairs, "doc", "left").mapInPandas(run, "loaded_id bigint, text string")


def join_paragraphs(text: str, repairs: list) -> str:
    """The text without furniture, broken words joined and misread ones replaced; an empty line inside a page ends a paragraph."""
    gone = {r["line"] for r in repairs if r["damage"] == "furniture"}
    broken = {r["line"]: r for r in repairs if r["damage"] == "hyphen"}
    wrong: dict[int, list] = {}
    for r in repairs:
        if r["damage"] == "misread":
            wrong.setdefault(r["line"], []).append(r)
    paragraphs, current = [], ""
    carry = None
    for k, line in enumerate(text.split("\n")):
        if k in gone:
            continue
        bare = line.replace("\f", "").strip()
        if not bare:
            # an empty line within a sentence is a page break
            if carry is None and current and current[-1] in ".!?:":
                paragraphs.append(current)
                current = ""
            continue
        for r in wrong.get(k, ()):
            bare = re.sub(rf"(?<![^\s(]){re.escape(r['left'])}(?![^\s{re.escape(PUNCT)}])", lambda _, w=r["repaired"]: w, bare, count=1)
        if carry is not None:
            head, _, rest = bare.partition(" ")
            tail = head[len(head.rstrip(PUNCT)) :]
            bare = carry + tail + (" " + rest if rest else "")
            carry = None
        if k in broken:
            start, _, end = bare.rpartition(" ")
            carry = end[: len(end) - len(end.lstrip(PUNCT))] + broken[k]["repaired"]
            bare = start
        if bare:
            current = f"{current} {bare}" if current else bare
    if carry is not None:
        current = f"{current} {carry}".strip()
    if current:
        paragraphs.append(current)
    return "\n\n".join(paragraphs)


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_texts(table(spark, sf_dir, "loaded_document"))
