"""Personal data by bootstrapped contextual extraction (operator 10).

Seeds are what the four fixed patterns find (``base_spans``).  Every seed and every other identifier-like piece of
text (one token or several: numbers in groups, addresses with the at sign spelled out) occurs in contexts, the words
beside it.  These contexts are patterns; of the piece itself they know only whether it is like a mail address or
like a number.  Spark scores the graph of patterns and instances in rounds: a pattern is as reliable as its
instances are known, an instance as likely as the noisy-or of its patterns.  Instances that reliable, well supported
patterns tag are known in the next round and support further patterns, until a round tags nothing new.  Base spans
always stay.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import read, stable, text_or_empty

# fixed values: the contract's kinds in their order
KINDS = ("email", "ip", "card", "phone")
MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits, so the look-behind only spares fruitless starts
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]+")
EDGE = "\"'`.,;:!?()[]{}<>"
NUMERIC = re.compile(r"[0-9+().\-\u2013/]+")
# what may stand between the groups of one number
JOINT = re.compile(r"\)?[ \t\xa0]{1,2}(?:[-\u2013/][ \t\xa0]{1,2})?\(?")
LABEL = re.compile(r"[^\W\d_]+[:=]+")
# at sign and dots of an address, spelled out, in brackets or apart
DOT = r"(?:\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|punkt|punto|point)\s|\.)"
SPELLED = re.compile(r"(?:\s?[\[({<]\s?(?:at|ät|arroba|arobase|@)\s?[\])}>]\s?|\s(?:at|ät|arroba|arobase)\s|\s@\s?|@\s)[^\W_][\w-]*(?:" + DOT + r"[\w-]+)+", re.I)
DOT_BEFORE = re.compile(DOT + r"\Z", re.I)
WORD = re.compile(r"\S+")

MIN_SUPPORT = 5      # distinct seeds a pattern must have met
MIN_PATTERN = 0.8    # share of its instances that must be known
MIN_INSTANCE = 0.9
SMOOTHING = 1.0
FEWEST = 5           # digits of a number that can name a person; an address of four parts may have fewer
MOST = 19            # digits of a part of a number, as in the longest card; the whole number may have any
LONG = 64            # longer names of words and values are kept as their digests


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, by kind and start."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        end = 0
        for m in MAIL_TAIL.finditer(text):
            at = m.start()
            while at > end and text[at - 1] in LOCAL:
                at -= 1
            if at < m.start():
                out.append((0, at, m.end()))
                end = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def named(x: str) -> str:
    """The lower-cased text itself or, if it is long, its digest."""
    x = x.lower()
    return x if len(x) <= LONG else "\x1e" + hashlib.sha256(x.encode()).hexdigest()


def looks_numeric(piece: str, fewest: int) -> bool:
    return sum(c in "0123456789" for c in piece) >= fewest or piece.count(".") >= 3 and any(c in "0123456789" for c in piece)


def marked_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign, without punctuation at their edges and without a label before them."""
    last = 0
    for m in MARK.finditer(text):
        if m.start() < last:
            continue
        a, b = m.start(), m.end()
        while a > last and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        last = b
        while a < b and text[a] in EDGE:
            a += 1
        label = LABEL.match(text, a, b)
        if label:
            a = label.end()
            while a < b and text[a] in EDGE:
                a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        if b > a:
            yield a, b


def spelled_addresses(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose at sign or dots are spelled out, in brackets or apart."""
    last = 0
    for m in SPELLED.finditer(text):
        a = m.start()
        while True:
            end = a
            while a > last and (text[a - 1].isalnum() or text[a - 1] in LOCAL):
                a -= 1
            if a == end:
                break
            dot = DOT_BEFORE.search(text, max(last, a - 12), a)
            if not dot or dot.start() == last or not text[dot.start() - 1].isalnum():
                break
            a = dot.start()
        last = m.end()
        while a < m.start() and text[a] in EDGE:
            a += 1
        if a < m.start():
            yield a, m.end()


def other_pieces(text: str, taken: list[tuple[int, int, int]], fewest: int = FEWEST) -> list[tuple[int, int, bool]]:
    """Start and end of every identifier-like piece that no span touches, and whether it is a whole.

    Tokens of digits and signs that follow each other are one number; its parts of up to ``MOST`` digits, down to a
    token of any, are pieces too.
    """
    spans = sorted((s, e) for _, s, e in taken)
    starts = [s for s, _ in spans]
    ends = list(accumulate((e for _, e in spans), max))

    def free(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k == 0 or ends[k - 1] <= a

    out = [(a, b, True) for a, b in spelled_addresses(text) if free(a, b)]
    run: list[tuple[int, int, int]] = []  # start, end and digits of the groups of one number

    def flush() -> None:
        def add(i: int, j: int) -> None:
            a, b = run[i][0], run[j][1]
            if looks_numeric(text[a:b], fewest) and free(a, b):
                opened = a > 0 and text[a - 1] == "(" and ")" in text[a:b]
                out.append((a - opened, b, i == 0 and j == len(run) - 1))

        for i in range(len(run)):
            digits = 0
            for j in range(i, len(run)):
                digits += run[j][2]
                if j > i and digits > MOST:
                    if i == 0:
                        add(0, len(run) - 1)
                    break
                add(i, j)
        run.clear()

    for a, b in marked_tokens(text):
        piece = text[a:b]
        if NUMERIC.fullmatch(piece) and free(a, b):
            if run and not JOINT.fullmatch(text, run[-1][1], a):
                flush()
            run.append((a, b, sum(c in "0123456789" for c in piece)))
            continue
        flush()
        if ("@" in piece and any(c.isalnum() for c in piece) or looks_numeric(piece, fewest)) and free(a, b):
            out.append((a, b, True))
    flush()
    return out


class Surroundings:
    """The words beside a place of one text, however long they are and whatever space lies between."""

    def __init__(self, text: str):
        self.text, self.known = text, {}

    def before(self, start: int) -> list[str]:
        """The last two words."""
        if start not in self.known:
            out, b = [], start
            for _ in range(2):
                while b > 0 and self.text[b - 1].isspace():
                    b -= 1
                a = b
                while a > 0 and not self.text[a - 1].isspace():
                    a -= 1
                if a < b:
                    out.insert(0, self.bare(self.text[a:b]))
                b = a
            self.known[start] = out
        return self.known[start]

    def after(self, end: int) -> str:
        """The next word."""
        m = WORD.search(self.text, end)
        return self.bare(m.group()) if m else ""

    @staticmethod
    def bare(word: str) -> str:
        return named(word.strip(EDGE) or word)

    def contexts(self, start: int, end: int, like: str) -> list[str]:
        """Pattern names of an occurrence: the words before, after, and on both sides."""
        before, right = self.before(start), self.after(end)
        left = " ".join(before[-1:])
        return [f"{like}\x1f{x}" for x in (f"< {left}", f"> {right}", f"<> {left} _ {right}", f"<< {' '.join(before)}")]


def like(kind: int, piece: str) -> str:
    """The loose class of a piece: a mail address or a number."""
    return "mail" if kind == 0 or kind < 0 and ("@" in piece or SPELLED.search(piece)) else "number"


OCCURRENCE = "array<struct<kind:int,begin:int,stop:int,value:string,whole:boolean,patterns:array<string>>>"


def find_occurrences(docs: DataFrame, id_col: str, text_col: str, fewest: int = FEWEST) -> DataFrame:
    """``doc_id, occ``: every base span (kind 0-3) and other piece (kind -1) of each text with its contexts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = []
            for t in b.column(1).to_pylist():
                base, beside = base_spans(t), Surroundings(t)
                every = [*((k, s, e, True) for k, s, e in base), *((-1, s, e, w) for s, e, w in other_pieces(t, base, fewest))]
                found.append([{"kind": k, "begin": s, "stop": e, "value": named(t[s:e]), "whole": w, "patterns": beside.contexts(s, e, like(k, t[s:e]))}
                              for k, s, e, w in every])
            shape_ = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("whole", pa.bool_()),
                                        ("patterns", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, shape_)], ["doc_id", "occ"])

    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, occ {OCCURRENCE}")


def discovered(occ: DataFrame, support: int = MIN_SUPPORT) -> DataFrame:
    """``value, whole, kind, p`` of instances that reliable patterns tag.  ``occ``: value, whole, kind (-1 unknown), pattern.

    A part of a longer number is an instance of its own, and no evidence for or against a pattern.
    """
    edges = stable(occ.groupBy("pattern", "value", "whole").agg(F.max("kind").alias("kind")))
    # a pattern that meets fewer instances can never have the support
    met = edges.filter("whole").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("pattern")
    edges = stable(edges.join(met, "pattern"))
    known = None
    while True:
        seen = edges if known is None else edges.join(known.withColumnRenamed("kind", "guess"), ["value", "whole"], "left")
        is_ = F.col("kind") if known is None else F.when(F.col("kind") < 0, F.coalesce("guess", F.lit(-1))).otherwise(F.col("kind"))
        weight = F.lit(1.0) if known is None else F.when(F.col("kind") < 0, F.coalesce("p", F.lit(0.0))).otherwise(1.0)
        by_pattern = seen.filter("whole").select("pattern", is_.alias("is"), weight.alias("w")).groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("is") >= 0).alias("support"),
            *[F.sum(F.when(F.col("is") == k, F.col("w")).otherwise(0.0)).alias(f"w{k}") for k in range(len(KINDS))])
        # the kind a pattern speaks for is the one most of its known instances have, the earlier listed of two
        top = F.greatest(*[F.col(f"w{k}") for k in range(len(KINDS))])
        says = F.coalesce(*[F.when(F.col(f"w{k}") == top, F.lit(k)) for k in range(len(KINDS))])
        trust = by_pattern.filter(F.col("support") >= support).select("pattern", says.alias("says"), (top / (F.col("n") + SMOOTHING)).alias("conf"))
        tagged = edges.filter("kind < 0").join(trust.filter(F.col("conf") >= MIN_PATTERN), "pattern")
        by_kind = tagged.groupBy("value", "whole", "says").agg((1 - F.exp(F.sum(F.log1p(-F.least("conf", F.lit(0.999)))))).alias("p"))
        found = by_kind.groupBy("value", "whole").agg(F.max_by("says", F.struct("p", -F.col("says"))).alias("kind"), F.max("p").alias("p")).filter(
            F.col("p") >= MIN_INSTANCE)
        if known is None:
            known = stable(found)
            if known.isEmpty():
                return known
            continue
        # what is tagged stays tagged, so the rounds end
        new = stable(found.join(known.select("value", "whole"), ["value", "whole"], "left_anti"))
        if new.isEmpty():
            return known
        known = stable(known.unionByName(new))


def apart(found: list[dict]) -> list[dict]:
    """Of pieces that overlap the likelier, then the longer, then the earlier."""
    starts, out = [], []
    for x in sorted(found, key=lambda x: (-round(x["p"], 9), x["begin"] - x["stop"], x["begin"], x["kind"])):
        k = bisect_left(starts, x["stop"])
        if k == 0 or out[k - 1]["stop"] <= x["begin"]:
            starts.insert(k, x["begin"])
            out.insert(k, x)
    return out


def joined(spans: str) -> str:
    """SQL: kind:start:end of an array of structs, by kind and start."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return (f"array_join(transform(array_sort({spans}), x -> "
            f"concat(element_at(array({names}), x.kind + 1), ':', x.begin, ':', x.stop)), ',')")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fewest: int = FEWEST, support: int = MIN_SUPPORT) -> DataFrame:
    """Counts of base spans per kind, their digest, and all spans with those the contexts found.

    A number needs ``fewest`` digits to be found by its context, a pattern ``support`` known instances to be believed.
    Neither pieces nor the words beside them have a greatest length.

    A null text counts as empty; a null id stays null; repeated rows give repeated results.  An instance that
    reliable patterns give to two kinds goes to the likelier, then the earlier listed; of found instances that
    overlap the likelier stays, then the longer, then the earlier.  Other columns are ignored.
    """
    rows = stable(find_occurrences(docs, id_col, text_col, fewest).withColumn("row", F.monotonically_increasing_id()))
    one = rows.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    new = discovered(one.select("value", "whole", "kind", F.explode("patterns").alias("pattern")), support)
    more = (one.filter("kind < 0").select("row", "begin", "stop", "value", "whole").join(new, ["value", "whole"])
            .groupBy("row").agg(F.collect_list(F.struct("kind", "begin", "stop", "p")).alias("added")))  # at most a document's own pieces

    def choose(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int32()), ("stop", pa.int32())]))
        for b in batches:
            added = [[{k: x[k] for k in ("kind", "begin", "stop")} for x in apart(found)] for found in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(added, kind)], ["row", "added"])

    more = more.mapInArrow(choose, "row long, added array<struct<kind:int,begin:int,stop:int>>")
    base = "transform(filter(occ, x -> x.kind >= 0), x -> named_struct('kind', x.kind, 'begin', x.begin, 'stop', x.stop))"
    out = rows.select("row", "doc_id", F.expr(base).alias("base")).join(stable(more), "row", "left")
    out = out.withColumn("every", F.expr("concat(base, coalesce(added, array()))"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("every")).alias("spans"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data(read(spark, sf_dir, "documents"))
