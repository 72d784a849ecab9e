"""Benchmark decontamination over template windows.

A text becomes a template: numbers, units after numbers and names (capitalised words inside a
sentence) turn into typed placeholders, other words are lower-cased and lose their outer
punctuation. Windows of ``WINDOW`` template words are hashed and joined with those of the
benchmark, so that a question with other numbers or names still meets its original. Where
windows of a document meet an item along one diagonal, the slots must be consistent: a value
of the item always became the same value in the document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, save
from .minhash import mixed

WINDOW = 8
LEAST_WORDS = 5
#: Hashes of benchmark windows set bits of a filter of 2**FILTER bits, which all tasks get.
FILTER = 26
UNITS = frozenset("mm cm m km in ft mi g kg mg lb oz ml l s ms sec min h hr hours hour minutes seconds day days week weeks month months year years usd eur dollars dollar cents euros percent % ° °c °f kmh mph kw kwh w v a hz khz mhz ghz kb mb gb tb meters metres meter kilometers miles mile inches feet grams kilograms pounds liters litres".split())
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "%<>") + "“”‘’«»…¿¡"
_MIX = np.uint64(0x9E3779B97F4A7C15)
LITERAL, NUMBER, NAME, UNIT = range(4)
PLAIN, TEMPLATE, RENAMED, FOLDED = range(4)
_SLOT = ("", "<num>", "<name>", "<unit>")
_SLOT_HASH = np.array([0, *(xxhash.xxh64_intdigest(s) for s in _SLOT[1:])], np.uint64)


class Words(dict):
    """Raw word -> number; what matters of a word is kept in growing arrays under its number."""

    def __init__(self):
        self.traits = [np.empty(1 << 12, t) for t in (np.uint64, np.int8, bool, bool, bool)]

    def __missing__(self, word: str) -> int:
        plain = word.strip(_OUTER)
        kind = NUMBER if any(c.isdigit() for c in plain) else NAME if plain[:1].isupper() else LITERAL
        low = plain.lower()
        self[word] = n = len(self)
        if n == len(self.traits[0]):
            self.traits = [np.concatenate([t, np.empty_like(t)]) for t in self.traits]
        ends = word.rstrip("\"')]”’»")[-1:] in tuple(".!?:")
        for trait, x in zip(self.traits, (xxhash.xxh64_intdigest(low), kind, low in UNITS, ends, bool(plain)), strict=True):
            trait[n] = x
        return n


class Templates:
    """Template words of texts, all texts in one row of arrays; bare punctuation is no word.

    ``words`` are the raw words, ``text`` the numbers of their texts, ``low`` hashes of the plain
    words, ``kind`` their slot kinds, and ``named`` the literals that may be names: capitalised
    words that start a sentence.
    """

    def __init__(self, texts: Sequence[str], seen: Words):
        if len(seen) > 500_000:
            seen.clear()
        split = [t.split() for t in texts]
        words = list(chain.from_iterable(split))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        text = np.repeat(np.arange(len(split)), sizes)
        ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        self.low, self.kind, unit, ends, real = (t[ids] for t in seen.traits)
        begins = np.ones(len(words), bool)
        begins[1:] = text[1:] != text[:-1]
        self.kind[1:][unit[1:] & (self.kind[:-1] == NUMBER) & ~begins[1:]] = UNIT
        begins[1:] |= ends[:-1]
        self.named = begins & (self.kind == NAME)
        self.kind[self.named] = LITERAL
        self.words, self.text = words, text
        if not real.all():
            at = np.flatnonzero(real)
            self.words = [words[i] for i in at.tolist()]
            self.low, self.kind, self.named, self.text = self.low[at], self.kind[at], self.named[at], text[at]

    def windows(self, n: int) -> np.ndarray:
        """Starts of the windows of ``n`` words that lie in one text."""
        m = len(self.text) - n + 1
        return np.flatnonzero(self.text[:m] == self.text[n - 1 :]) if m > 0 else np.empty(0, np.int64)

    def forms(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Form, starts, hashes and slot kinds (of all words) of the windows of ``n`` words.

        Every window has the plain form: it hashes the lower-cased words and has no slots; a
        template without slots is its window's plain form. The other forms are for windows with
        slots, but at most half: the template; the renamed form, which takes capitalised words
        that start a sentence for names, too; the folded form, which takes no word for a name,
        so that it does not hang on the case.
        """
        whole = self.windows(n)
        if not len(whole):
            return
        yield PLAIN, whole, self._hashed(self.low, n, whole), np.full(len(self.kind), LITERAL, np.int8)
        if n < LEAST_WORDS:
            return
        slots, more = _count(self.kind != LITERAL, n)[whole], _count(self.named, n)[whole]
        names = _count(self.kind == NAME, n)[whole]
        for form, count, has, kind in (
            (TEMPLATE, slots, slots > 0, lambda: self.kind),
            (RENAMED, slots + more, more > 0, lambda: np.where(self.named, np.int8(NAME), self.kind)),
            (FOLDED, slots - names, (slots > names) & (names > 0), lambda: np.where(self.kind == NAME, np.int8(LITERAL), self.kind)),
        ):
            at = whole[has & (2 * count <= n)]
            if len(at):
                kind = kind()
                yield form, at, self._hashed(np.where(kind == LITERAL, self.low, _SLOT_HASH[kind]), n, at), kind

    def _hashed(self, h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        if 4 * len(at) < len(h):
            out = np.full(len(at), n, np.uint64)
            for j in range(n):
                out = out * _MIX + h[at + j]
            return mixed(out)
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out = out * _MIX + h[j : len(h) - n + 1 + j]
        return mixed(out[at])

    def slots(self, kind: np.ndarray, at: int, n: int) -> list[str]:
        return [f"{_SLOT[k]}{w.strip(_OUTER)}" for w, k in zip(self.words[at : at + n], kind[at : at + n].tolist(), strict=True) if k]


def _count(x: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x)])
    return total[n:] - total[:-n]


def bits_of(hashes: DataFrame) -> np.ndarray:
    """The filter of ``hashes(h)``: 64-bit words, made by the tasks; of fixed size however many hashes there are."""
    slot = F.shiftrightunsigned("h", 64 - FILTER)
    parts = hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER}) & 63 as int))")).alias("bits"))
    got = parts.toArrow()
    out = np.zeros(1 << (FILTER - 6), np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - FILTER)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


_ROWS = "id {0}, n int, at long, h long, slots array<string>, form int"


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = 0.5, consistency: float = 0.75) -> DataFrame:
    """Rows ``(doc_id, item_id, n_windows, n_matched, coverage, n_slots, consistency)`` of the leaks.

    A leak is a document that holds, on diagonals of consistent slots, at least ``coverage`` of
    an item's windows, or of those of them that are at least half literal words; ``coverage`` is
    the greater share, the counts are of all windows. Windows equal word by word count whatever
    the slots around them and whatever the case; names in another case count as words, so a copy
    in other case may have other numbers, and of its names those outside the windows needed. Items of fewer than ``WINDOW`` words are one window; those of fewer than ``LEAST_WORDS`` words match
    only word by word, apart from case and outer punctuation. Items null, empty or of bare
    punctuation match nothing. Null document
    text: empty. Null ids: left out. Rows that repeat an id are one document's or item's
    passages. Empty inputs: no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    kinds = {c: dict(x.dtypes)["id"] for c, x in (("doc", docs), ("item", items))}

    def index(rows: dict, seen: Words) -> dict:
        out = {c: [] for c in ("id", "n", "at", "h", "slots", "form", "rich")}
        for i, text in zip(rows["id"], rows["text"], strict=True):
            t = Templates([text], seen)
            n = min(WINDOW, len(t.words))
            rich = 2 * _count(t.kind != LITERAL, n) <= n if n else ()
            for form, at, x, kind in t.forms(n) if n else ():
                for a, y in zip(at.tolist(), x.view(np.int64).tolist(), strict=True):
                    for c, v in zip(out, (i, n, a, y, t.slots(kind, a, n), form, bool(rich[a])), strict=True):
                        out[c].append(v)
        return out

    wanted = save(map_rows(items, index, _ROWS.format(kinds["item"]) + ", rich boolean", Words))
    sizes = [r.n for r in wanted.select("n").distinct().collect()]  # at most WINDOW of them
    sent = spark.sparkContext.broadcast(bits_of(wanted.select("h")))

    def probe(rows: dict, seen: Words) -> dict:
        t, out = Templates(rows["text"], seen), {c: [] for c in ("id", "n", "at", "h", "slots", "form")}
        begin = np.searchsorted(t.text, np.arange(len(rows["id"]))).tolist()
        for n in sizes:
            for form, at, x, kind in t.forms(n):
                hit = _passing(sent.value, x)
                for a, y in zip(at[hit].tolist(), x[hit].view(np.int64).tolist(), strict=True):
                    k = t.text[a]
                    for c, v in zip(out, (rows["id"][k], n, a - begin[k], y, t.slots(kind, a, n), form), strict=True):
                        out[c].append(v)
        return out

    # Written, so that no plan of the join reads the texts twice.
    there = save(map_rows(docs, probe, _ROWS.format(kinds["doc"]), Words))
    pairs = F.zip_with("slots", "item_slots", lambda d, b: F.struct(b.alias("b"), d.alias("d")))
    item = wanted.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "n", "h", F.col("slots").alias("item_slots"), F.col("form").alias("item_form"), "rich")
    met = there.join(item, ["h", "n"]).select(F.col("id").alias("doc_id"), "item_id", "item_at", "rich", (F.col("at") - F.col("item_at")).alias("diagonal"), pairs.alias("slots"), F.greatest("form", "item_form").alias("form"))
    # Lines of templates are judged alone and once more with the renamed and with the folded windows beside them.
    lines = F.when(F.col("form") == TEMPLATE, F.array(*map(F.lit, (TEMPLATE, RENAMED, FOLDED)))).otherwise(F.array("form"))
    met = met.withColumn("form", F.explode(lines))
    line = met.groupBy("doc_id", "item_id", "diagonal", "form").agg(F.collect_set("item_at").alias("at"), F.collect_set(F.when(F.col("rich"), F.col("item_at"))).alias("rich"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    line = line.withColumn("values", F.size(F.array_distinct(F.transform("slots", lambda s: s["b"]))))
    line = line.withColumn("same", F.when(F.size("slots") == 0, 1.0).otherwise(F.col("values") / F.size("slots"))).where(F.col("same") >= consistency)
    found = line.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"), F.size(F.array_distinct(F.flatten(F.collect_list("rich")))).alias("rich_matched"), F.max("values").cast("long").alias("n_slots"), F.min("same").alias("consistency"))
    total = wanted.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("at").alias("n_windows"), F.countDistinct(F.when(F.col("rich"), F.col("at"))).alias("n_rich"))
    out = found.join(total, "item_id").withColumn("coverage", F.greatest(F.col("n_matched") / F.col("n_windows"), F.when(F.col("n_rich") > 0, F.col("rich_matched") / F.col("n_rich"))))
    return out.where(F.col("coverage") >= coverage).select("doc_id", "item_id", "n_windows", "n_matched", "coverage", "n_slots", "consistency")
