"""Problem 2: free-typed values mapped to the entries of a reference list.

The reference entries form a trie of squeezed letters, with alias paths for synonyms and for the words of an entry in any
order. A typed value is searched with a Levenshtein automaton (rows of edit distances carried down the trie, neighbouring
letters swapped counting as one edit) and every entry within a distance that depends on the value's length comes out.
Added remarks are tried with and without; side abbreviations are written out first; a shortened word ('moder.') is a prefix
that must fit one entry only.

Defined results: missing values (null, blank, 'n/a', '-' and the like) and values that are a term letter for letter are no
case; an unmatched value, or one that fits several codes equally well, has the code NONE; null or empty finding arrays give
no row; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.llm.textnorm import fold
from carrel.session import table

# How a missing value and the two sides are written.
MISSING = ("", "n/a", "na", "-", "--", "null", "none given", "unknown")
SIDES = {"r": "right", "rt": "right", "rgt": "right", "re": "right", "l": "left", "lt": "left", "lft": "left", "li": "left"}
DIGIT_LETTERS = {"0": "o", "1": "l", "5": "s"}


def distance_limit(length: int) -> int:
    """Edits allowed for a squeezed value of this length."""
    return 0 if length <= 3 else 1 if length <= 5 else 2


class Trie:
    """Letters to child nodes; codes stand at the end of each path."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, code: str) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(code)

    def within(self, text: str, limit: int) -> dict[str, int]:
        """code -> least distance of the entries within the limit; an entry's own length may allow less or more.

        The rows of edit distances are kept only within a band of `limit` about the diagonal.
        """
        found: dict[str, int] = {}
        n = len(text)
        far = limit + 1

        def visit(node: dict, row: list[int], before: list[int] | None, last: str, depth: int) -> None:
            d = row[n]
            if d <= limit and "" in node and d <= distance_limit(max(n, depth)):
                for code in node[""]:
                    if d < found.get(code, far):
                        found[code] = d
            low, high = max(1, depth + 1 - limit), min(n, depth + 1 + limit)
            if low > n:
                return
            for c, child in node.items():
                if c == "":
                    continue
                new = [far] * (n + 1)
                if depth < limit:
                    new[0] = depth + 1
                least = new[0]
                for i in range(low, high + 1):
                    t = text[i - 1]
                    if t == c:
                        d = row[i - 1]
                    else:
                        d = row[i - 1]
                        if row[i] < d:
                            d = row[i]
                        if new[i - 1] < d:
                            d = new[i - 1]
                        d += 1
                        if before is not None and i > 1 and t == last and text[i - 2] == c and before[i - 2] + 1 < d:
                            d = before[i - 2] + 1
                    new[i] = d
                    if d < least:
                        least = d
                if least <= limit:
                    visit(child, new, row, c, depth + 1)

        visit(self.root, [i if i <= limit else far for i in range(n + 1)], None, "", 0)
        return found

    def begins(self, text: str, limit: int) -> bool:
        """Whether some path begins with a form of the text at most limit edits away."""
        n = len(text)
        far = limit + 1

        def visit(node: dict, row: list[int], before: list[int] | None, last: str, depth: int) -> bool:
            if row[n] <= limit:
                return True
            low, high = max(1, depth + 1 - limit), min(n, depth + 1 + limit)
            if low > n:
                return False
            for c, child in node.items():
                if c == "":
                    continue
                new = [far] * (n + 1)
                if depth < limit:
                    new[0] = depth + 1
                for i in range(low, high + 1):
                    t = text[i - 1]
                    d = row[i - 1] if t == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    if t != c and before is not None and i > 1 and t == last and text[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    new[i] = d
                if min(new) <= limit and visit(child, new, row, c, depth + 1):
                    return True
            return False

        return visit(self.root, [i if i <= limit else far for i in range(n + 1)], None, "", 0)

    def completions(self, prefix: str) -> set[str]:
        """Codes of all paths that start with the prefix."""
        node = self.root
        for c in prefix:
            if c not in node:
                return set()
            node = node[c]
        out: set[str] = set()
        stack = [node]
        while stack:
            x = stack.pop()
            for c, child in x.items():
                if c == "":
                    out |= child
                else:
                    stack.append(child)
        return out


def _tokens(text: str) -> list[str]:
    """Folded words; a digit inside a word counts as the letter it looks like; sides are written out."""
    out = []
    for w in re.findall(r"[^\W_]+\.?", fold(text.replace("ß", "s"))):
        bare = w.rstrip(".")
        if re.search(r"[a-z]", bare) and re.search(r"\d", bare):
            # a 1 or 5 that ends the word may be a grade
            w = bare = re.sub(r"0|[15](?=[a-z])", lambda m: DIGIT_LETTERS[m[0]], bare)
        out.append(SIDES.get(bare, w))
    return out


def _squeeze(tokens: list[str]) -> str:
    return "".join(t.rstrip(".") for t in tokens)


class Reference:
    """The trie of one vocabulary; rows are (code, names), the term first.

    Names of up to most_permuted words stand in the trie in every order of their words; longer ones in their own order and
    with the words sorted, and values of so many words are searched in both ways too.
    """

    def __init__(self, rows: list[tuple[str, list[str]]], most_permuted: int = 4) -> None:
        self.trie = Trie()
        self.most_permuted = most_permuted
        #: first letters of a name's words, sorted -> (code, words): only these can be what shortened words stand for
        self.by_letters: dict[str, list[tuple[str, list[str]]]] = {}
        self.beginnings: set[str] = set()
        self.long_words: set[str] = set()
        self.longest = self.most_words = 0
        for code, names in rows:
            for name in [*names, *(n.replace("ß", "ss") for n in names if "ß" in n)]:
                tokens = [t.rstrip(".") for t in _tokens(name)]
                if not tokens:
                    continue
                self.by_letters.setdefault("".join(sorted(t[0] for t in tokens)), []).append((code, tokens))
                self.beginnings.update(t[:k] for t in tokens for k in range(1, len(t) + 1))
                if len(tokens) > most_permuted:
                    self.long_words.update(tokens)
                orders = permutations(tokens) if len(tokens) <= most_permuted else [tokens, sorted(tokens)]
                for order in orders:
                    self.trie.add("".join(order), code)
                self.longest = max(self.longest, sum(map(len, tokens)))
                self.most_words = max(self.most_words, len(tokens))

    def readings(self, parts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """(remarks left out, words) of the head with any of its remarks, those with most remarks first.

        A remark is taken up only where an entry can go on with it, so their number follows the entries, not the value.
        """
        found: list[tuple[int, list[str]]] = []
        remarks = [_tokens(p) for p in parts[1:]]

        def extend(tokens: list[str], at: int, left_out: int) -> None:
            found.append((left_out + len(remarks) - at, tokens))
            for k in range(at, len(remarks)):
                if self._can_go_on(more := tokens + remarks[k]):
                    extend(more, k + 1, left_out + k - at)

        extend(_tokens(parts[0]), 0, 0)
        yield from sorted(found, key=lambda x: x[0])

    def _can_go_on(self, tokens: list[str]) -> bool:
        text = _squeeze(tokens).removesuffix("ly")
        if len(text) > self.longest + 2:
            return False
        if any(t.endswith(".") for t in tokens) or len(tokens) > self.most_permuted:
            return len(tokens) <= self.most_words and all(t[:-1] in self.beginnings for t in tokens if t.endswith("."))
        # the words of a long name may come in any order, which the trie does not hold
        return self.trie.begins(text, 2) or len(tokens) <= self.most_words and self.long_words.issuperset(tokens)

    def lookup(self, typed: str) -> dict[str, int]:
        """code -> rank of the entries that fit, the best having the least.

        An entry met exactly ranks by the remarks left out, behind it one met by shortened words; entries met with d edits rank
        from FAR + d on. Ranks do not depend on the other entries, so that blocks of a reference can be put together.
        """
        parts = [p for p in re.split(r"\s*[,;()\[\]]\s*|\s+[-–:]\s+", typed.strip()) if re.search(r"\w", p)]
        best: dict[str, int] = {}
        if not parts:
            return best
        exact_at = None
        for left_out, tokens in self.readings(parts):
            if exact_at is not None and left_out > exact_at:
                break
            for code, (d, short) in self._whole(tokens).items():
                rank = FAR + d if d else 2 * min(left_out, FAR // 2 - 1) + short
                if d == 0:
                    exact_at = left_out
                best[code] = min(rank, best.get(code, rank))
        return best

    def _whole(self, tokens: list[str]) -> dict[str, tuple[int, bool]]:
        """code -> (edits, whether shortened words stand for it)."""
        found: dict[str, int] = {}
        texts = [_squeeze(tokens)]
        if len(tokens) > self.most_permuted:
            texts.append(_squeeze(sorted(tokens)))
        if len(texts[0]) <= self.longest + 2:
            for limit in range(distance_limit(len(texts[0]) + 1) + 1):
                for text in texts:
                    for code, d in self.trie.within(text, limit).items():
                        found[code] = min(d, found.get(code, d))
                if found:
                    break
        if texts[0].endswith("ly") and len(texts[0]) <= self.longest + 4:
            stem = texts[0][:-2]
            for code, d in self.trie.within(stem, distance_limit(len(stem))).items():
                found[code] = min(d, found.get(code, d))
        out = {code: (d, False) for code, d in found.items()}
        if any(t.endswith(".") for t in tokens):
            for code in self._shortened(tokens):
                if out.get(code, (1,))[0] > 0:
                    out[code] = (0, True)
        return out

    def _shortened(self, tokens: list[str]) -> set[str]:
        """Codes of the entries whose words start with the shortened ones."""
        if len(tokens) == 1:
            stem = tokens[0].rstrip(".")
            return self.trie.completions(stem) if len(stem) >= 2 else set()
        letters = "".join(sorted(t[0] for t in tokens))
        return {code for code, name in self.by_letters.get(letters, ()) if _stand_for(tokens, name)}

    def best(self, typed: str) -> tuple[str, int | None]:
        """(code, edits), or NONE if nothing or more than one code fits best."""
        found = self.lookup(typed)
        if not found:
            return "NONE", None
        least = min(found.values())
        codes = [c for c, d in found.items() if d == least]
        return (codes[0] if len(codes) == 1 else "NONE", max(0, least - FAR))


#: Ranks from here on are those of entries that are only near.
FAR = 1_000_000


def _stand_for(tokens: list[str], name: list[str]) -> bool:
    """Whether each token is a different word of the name, those with a full stop its beginning."""
    if not tokens:
        return not name
    t = tokens[0]
    return any((n.startswith(t[:-1]) if t.endswith(".") else n == t) and _stand_for(tokens[1:], name[:k] + name[k + 1 :]) for k, n in enumerate(name))


def _reference_rows(ontology: DataFrame) -> DataFrame:
    """(vocabulary, code, term, names) without null codes, each code once."""
    return (
        ontology.where("code IS NOT NULL AND vocabulary IS NOT NULL")
        .select("vocabulary", "code", F.coalesce("term", F.lit("")).alias("term"), F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))
        .select("vocabulary", "code", "term", F.filter(F.concat(F.array("term"), "synonyms"), lambda x: x.isNotNull()).alias("names"))
        .groupBy("vocabulary", "code")
        .agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    )


def match_values(values: DataFrame, ontology: DataFrame, block_rows: int = 20_000) -> DataFrame:
    """(vocabulary, value) to (vocabulary, value, code, distance).

    The distinct values are searched, spread over all cores. The reference goes to the tasks in blocks of about block_rows
    entries (one block here); the entries of the least rank over all blocks count, as in one block.
    """
    cores = values.sparkSession.sparkContext.defaultParallelism
    distinct = values.select("vocabulary", "value").where("vocabulary IS NOT NULL AND value IS NOT NULL").distinct().repartition(cores, "vocabulary", "value")
    rows = _reference_rows(ontology)
    blocks = max(1, -(-rows.count() // block_rows))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vocabulary", "code"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        entries: dict[str, list] = {}
        for r in keyed.where(F.col("block") == b).sort("vocabulary", "code").collect():  # about block_rows entries
            entries.setdefault(r["vocabulary"], []).append((r["code"], list(r["names"])))
        part = _search(distinct, entries)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        # the entries of the least rank, over all blocks
        all_ = found.groupBy("vocabulary", "value").agg(F.collect_list(F.struct("rank", "codes")).alias("all"))
        least = F.array_min(F.transform("all", lambda x: x["rank"]))
        found = all_.select("vocabulary", "value", least.alias("rank"), F.flatten(F.transform(F.filter("all", lambda x: x["rank"] == least), lambda x: x["codes"])).alias("codes"))
    return found.select(
        "vocabulary", "value", F.when(F.size("codes") == 1, F.get("codes", F.lit(0))).otherwise("NONE").alias("code"), F.greatest(F.col("rank") - FAR, F.lit(0)).alias("distance")
    )


def _search(distinct: DataFrame, entries: dict[str, list]) -> DataFrame:
    """(vocabulary, value, rank, codes): the entries of the least rank, both null and empty where none fits."""

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = {v: Reference(rows) for v, rows in entries.items()}
        for pdf in parts:
            out = []
            for vocabulary, value in zip(pdf["vocabulary"], pdf["value"]):
                found = tries[vocabulary].lookup(value) if vocabulary in tries else {}
                least = min(found.values(), default=None)
                out.append((vocabulary, value, least, [c for c, d in found.items() if d == least]))
            frame = pd.DataFrame(out, columns=["vocabulary", "value", "rank", "codes"])
            frame["rank"] = frame["rank"].astype("Int32")
            yield frame

    return distinct.mapInPandas(search, "vocabulary string, value string, rank int, codes array<string>")


def finding_values(reports: DataFrame) -> DataFrame:
    """(report_id, finding_no, field_name, value) of every entry of radiology_train.findings."""
    one = reports.select(F.col("report_id").cast("bigint").alias("report_id"), F.posexplode("findings").alias("pos", "f")).where("report_id IS NOT NULL")
    both = one.select(
        "report_id", F.col("pos").cast("bigint").alias("finding_no"),
        F.explode(F.array(F.struct(F.lit("anatomy").alias("field_name"), F.col("f.anatomy").alias("value")), F.struct(F.lit("severity").alias("field_name"), F.col("f.severity").alias("value")))).alias("v"),
    )
    return both.select("report_id", "finding_no", "v.field_name", "v.value").distinct()


def map_findings(reports: DataFrame, ontology: DataFrame) -> DataFrame:
    """(report_id, finding_no, field_name, value, code, distance) of the values that are no term letter for letter."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
    terms = ontology.select(F.col("vocabulary").alias("field_name"), key("term").alias("k")).where("k IS NOT NULL").distinct()
    typed = finding_values(reports).withColumn("k", key("value")).where(F.col("k").isNotNull() & ~F.col("k").isin(*MISSING))
    typed = typed.join(terms, ["field_name", "k"], "left_anti").drop("k")
    matched = match_values(typed.select(F.col("field_name").alias("vocabulary"), "value"), ontology)
    return typed.join(matched.withColumnRenamed("vocabulary", "field_name"), ["field_name", "value"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = map_findings(table(spark, sf_dir, "radiology_train"), table(spark, sf_dir, "ontology_result"))
    return out.select("report_id", "finding_no", "field_name", "code").distinct()


def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry, with their number."""
    out = map_findings(table(spark, sf_dir, "radiology_train"), table(spark, sf_dir, "ontology_result"))
    return out.where("code = 'NONE'").groupBy("field_name", "value").agg(F.count("*").alias("n"))
