"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.files import mapped, read_whole, written
from sievework.llm.session import Batches, cut, documents, fresh_path, in_batches, row_slices, set_aside, table, with_columns
from sievework.llm.tallies import gathered
from sievework.llm.wordscan import ALNUM, Scan, mix, scan, text_slices

#: Words of a window.
WINDOW = 10
#: Share of a document's words in hits from which the whole document goes.
COVERAGE = 0.5
#: Words of test items in one automaton, about. A benchmark of fewer is broadcast; one of more is dealt to several
#: automata, each built once, by a task, and written to the shared folder.
BLOCK_WORDS = 200_000
#: Bytes of text matched at once, with one automaton and with several (each is loaded once for so much), and automata that a task then holds.
SLICE, BLOCKS_SLICE, HELD = 500_000, 8_000_000, 3
#: Windows in a file of the directory of several automata, about.
PART_WINDOWS = 1_000_000

Item = tuple[str | None, str | None]
Spans = list[tuple[int, int]]
Finder = Callable[[np.ndarray, np.ndarray], "dict[int, Found]"]


@dataclass
class Found:
    """What was found in a text: disjoint ascending spans of words, items, and the longest match in words."""

    spans: Spans
    items: set
    longest: int


def words_of(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    s = scan(data, np.array([0, len(data)]), ALNUM)
    return [s.data[a:b].tobytes() for a, b in zip(s.start.tolist(), s.end.tolist(), strict=True)]


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items whose windows end in each state.

    After it is built the transitions are one table from (state, word) to state.
    """

    def __init__(self, items: Iterable[Item], window: int = WINDOW) -> None:
        self.window, ids = window, {}
        self._next, self.link, self.length = [{}], [-1], [0]
        listed = [(name, [ids.setdefault(w, len(ids)) for w in words_of(text)]) for name, text in items]
        listed = [(name, words) for name, words in listed if words]
        self.shortest = min([window, *(len(words) for _, words in listed)])
        for _, words in listed:
            state = 0
            for c in words:
                state = self._extend(state, c)
        # states may be cloned while items are added, so marks are set by a second walk
        marks: dict[int, set] = {}  # state of a window -> items
        short: dict[int, set] = {}  # state of a whole short item -> (words, item)
        for name, words in listed:
            state = 0
            for i, c in enumerate(words):
                state = self._next[state][c]
                if i + 1 >= window:
                    marks.setdefault(self._at(state, window), set()).add(name)
            if len(words) < window:
                short.setdefault(self._at(state, len(words)), set()).add((len(words), name))
        self.window_items: dict[int, tuple] = {}
        self.short_items: dict[int, tuple] = {}
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            if self.length[v] >= window and (of := marks.get(self._at(v, window))):
                self.window_items[v] = tuple(of)
            found = self.short_items.get(self.link[v], ()) + tuple(short.get(v, ()))
            if found:
                self.short_items[v] = found
        self.size = max(1, len(ids))
        self.next = {state * self.size + c: to for state, out in enumerate(self._next) for c, to in out.items()}
        del self._next
        joined = b" ".join(ids)
        self.words = scan(np.frombuffer(joined, dtype=np.uint8), np.array([0, len(joined)]), ALNUM)
        h = self.words.hashes()
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    def _at(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of what leads to ``state``."""
        while self.link[state] >= 0 and self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _clone(self, p: int, q: int, c: int) -> int:
        k = len(self.link)
        self._next.append(dict(self._next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = k
            p = self.link[p]
        self.link[q] = k
        return k

    def _extend(self, last: int, c: int) -> int:
        q = self._next[last].get(c)
        if q is not None:  # an earlier item has it
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        cur = len(self.link)
        self._next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self._next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return cur

    def places(self, s: Scan, hashes: np.ndarray) -> np.ndarray:
        """The number of each word among the items' words, or -1; equal hashes are compared byte by byte."""
        out = np.full(len(hashes), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            met = np.flatnonzero(self.hashes[at] == hashes)
            word = self.order[at[met]]
            out[met] = np.where(s.same(met, self.words, word), word, -1)
        return out

    def match(self, ids: np.ndarray, doc: np.ndarray, out: dict[int, Found]) -> None:
        """Add to ``out`` what is found in each text of words, given by number (-1: of no item) and text (ascending)."""
        count = np.bincount(doc, minlength=int(doc[-1]) + 1 if len(doc) else 0)
        first = np.cumsum(count) - count
        known = ids >= 0
        fresh, last = np.ones(len(known), dtype=bool), np.ones(len(known), dtype=bool)
        fresh[1:] = ~known[:-1] | (doc[1:] != doc[:-1])
        last[:-1] = ~known[1:] | (doc[1:] != doc[:-1])
        begins, ends = np.flatnonzero(known & fresh), np.flatnonzero(known & last) + 1
        whole = ends - begins >= self.shortest
        for a, b in zip(begins[whole].tolist(), ends[whole].tolist(), strict=True):
            d = int(doc[a])
            self.walk(ids[a:b].tolist(), a - int(first[d]), out.setdefault(d, Found([], set(), 0)))

    def walk(self, ids: list[int], at: int, found: Found) -> None:
        """Match a run of known words that begins at the word ``at`` of its text."""
        step, link, length, size, window = self.next.get, self.link, self.length, self.size, self.window
        whole, short, spans = self.window_items, self.short_items, found.spans
        state = matched = longest = 0
        for i, c in enumerate(ids, at + 1):
            to = step(state * size + c)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = step(state * size + c)
            if to is None:
                continue
            state = to
            matched += 1
            reach = 0
            if matched >= window:
                reach = matched
                found.items.update(whole[state])
            for m, item in short.get(state, ()):
                if m <= matched:
                    reach = max(reach, m)
                    found.items.add(item)
            if reach:
                longest = max(longest, matched)
                start = i - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        found.longest = max(found.longest, longest)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words that begin at each word but the last ones."""
    many = max(len(words) - n + 1, 0)
    h = np.full(many, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[j : j + many])
    return h


class Only:
    """One automaton that a task holds."""

    def __init__(self, items: list[Item]) -> None:
        self.automaton = ItemAutomaton(items)

    def finder(self, s: Scan, hashes: np.ndarray) -> Finder:
        """What finds hits in sequences of the scan's words: from words (by index) and the sequence of each, what is found in each sequence."""
        ids = self.automaton.places(s, hashes)

        def find(words: np.ndarray, sequence: np.ndarray) -> dict[int, Found]:
            out: dict[int, Found] = {}
            self.automaton.match(ids[words], sequence, out)
            return out

        return find


class Several:
    """Many automata in files, and a directory that says which of them have a window.

    The directory has the hash of each window and its automaton, ascending, dealt to files by the first bits of the hash. These are flat, so that the tasks of a machine
    that has the shared folder mounted map them and share the memory. Only words in windows that the directory has are matched, by the automata named
    there; a task holds few automata at a time.
    """

    def __init__(self, folder: str, parts: int, sizes: list[int]) -> None:
        self.folder, self.sizes = folder, sizes
        self.shift = np.uint64(64 - (parts - 1).bit_length()) if parts > 1 else None
        self.parts = [(mapped(f"{folder}/hashes-{k:06d}", "<u8"), mapped(f"{folder}/blocks-{k:06d}", "<i4")) for k in range(parts)]
        self._held: OrderedDict[int, ItemAutomaton] = OrderedDict()

    def _automaton(self, block: int) -> ItemAutomaton:
        if block not in self._held:
            if len(self._held) >= HELD:
                self._held.popitem(last=False)
            self._held[block] = pickle.loads(read_whole(f"{self.folder}/block-{block:06d}"))
        self._held.move_to_end(block)
        return self._held[block]

    def _candidates(self, hashes: np.ndarray, doc: np.ndarray) -> dict[int, np.ndarray]:
        """By automaton, which words are in windows that it may have."""
        out: dict[int, np.ndarray] = {}
        for n in self.sizes:
            h = window_hashes(hashes, n)
            at = np.flatnonzero(doc[: len(h)] == doc[n - 1 :][: len(h)])
            at = at[np.argsort(h[at], kind="stable")]
            h = h[at]
            cuts = [0, len(h)] if self.shift is None else np.searchsorted(h >> self.shift, np.arange(len(self.parts) + 1, dtype=np.uint64))
            for (known, blocks), a, b in zip(self.parts, cuts, cuts[1:], strict=False):
                low, high = np.searchsorted(known, h[a:b], "left"), np.searchsorted(known, h[a:b], "right")
                for i in np.flatnonzero(high > low).tolist():
                    for block in blocks[low[i] : high[i]].tolist():
                        out.setdefault(block, np.zeros(len(doc), dtype=bool))[at[a + i] : at[a + i] + n] = True
        return out

    def finder(self, s: Scan, hashes: np.ndarray) -> Finder:
        """As that of :class:`Only`."""

        def find(words: np.ndarray, sequence: np.ndarray) -> dict[int, Found]:
            out: dict[int, Found] = {}
            for block, inside in sorted(self._candidates(hashes[words], sequence).items()):
                automaton, at = self._automaton(block), np.flatnonzero(inside)
                ids = np.full(len(words), -1)
                ids[at] = automaton.places(s.of(words[at]), hashes[words[at]])
                automaton.match(ids, sequence, out)
                for f in out.values():
                    f.spans = joined(f.spans)
            return out

        return find


def cleaned(matcher: Only | Several, s: Scan, hashes: np.ndarray, data: np.ndarray, offsets: np.ndarray, found: dict[int, Found]) -> dict[int, bytes]:
    """The texts in ``found`` that have hits, without them, again and again while what is left makes new ones.

    What is left can only make a hit across a place where something went, so after the first round only the words around such places are looked at: the work
    follows the words that go, however deep hits are nested.
    """
    firsts = np.cumsum(np.append(0, s.counts()))
    done: dict[int, bytes] = {}
    for d, f in found.items():
        if f.spans:
            words, k = slice(int(firsts[d]), int(firsts[d + 1])), int(offsets[d])
            text = data[k : int(offsets[d + 1])]
            own = Scan(s.data[k : k + len(text)], np.array([0, len(text)]), s.start[words] - k, s.end[words] - k, np.zeros(words.stop - words.start, dtype=np.int64), 1)
            gone = _gone(matcher.finder(own, hashes[words]), words.stop - words.start, f.spans)
            parts, last = [], 0
            for a, b in np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2).tolist():
                parts.append(text[last : own.start[a]].tobytes())
                last = int(own.end[b - 1])
            parts.append(text[last:].tobytes())
            done[d] = b" ".join(x for x in (p.strip(b" ") for p in parts) if x)
    return done


def _gone(find: Finder, n: int, spans: Spans) -> np.ndarray:
    """Which of a text's ``n`` words go, as 0 or 1, from its first hits on."""
    gone = np.zeros(n, dtype=np.int8)
    # kept words as a linked list: after[i] and before[i + 1] of the word i, between the ends -1 and n
    after, before = [*range(1, n + 1), 0], [-2, *range(-1, n)]
    going = [w for a, b in spans for w in range(a, b)]
    while going:
        seams = set()
        for w in going:  # ascending, so the word before is none of them
            left, right = before[w + 1], after[w]
            after[left], before[right + 1] = right, left
            gone[w] = 1
            seams.add(left)
        words, sequence = [], []
        for left in sorted(seams):
            if left < 0 or after[left] == n:
                continue
            near, at = [], left
            while at >= 0 and len(near) < WINDOW - 1:
                near.append(at)
                at = before[at + 1]
            near.reverse()
            at = after[left]
            for _ in range(WINDOW - 1):
                if at == n:
                    break
                near.append(at)
                at = after[at]
            words.append(near)
            sequence.append(len(near))
        if not words:
            break
        flat = np.array([w for near in words for w in near])
        hits = find(flat, np.repeat(np.arange(len(words)), sequence))
        going = sorted({words[k][i] for k, f in hits.items() for a, b in f.spans for i in range(a, b)})
    return gone


def joined(spans: Spans) -> Spans:
    """Overlapping spans made one, in ascending order."""
    out: Spans = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def matcher_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[type, tuple]:
    """The class and arguments of a task's matcher: of one automaton if the items have BLOCK_WORDS words and sixteen times the bytes at most, else of several.

    Only a benchmark whose size was counted first reaches the driver. A larger one is dealt by a hash of the item to blocks of half
    as many words on average; each block's automaton is built by one task and lies in the shared folder, and so do the parts of the directory.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != ""))
    size = items.agg(F.coalesce(F.sum(n_words), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    if size["words"] <= BLOCK_WORDS and size["bytes"] <= 16 * BLOCK_WORDS and size["n"] <= BLOCK_WORDS:
        return Only, ([tuple(r) for r in items.collect()],)
    many = max(1, -(-2 * size["words"] // BLOCK_WORDS), -(-2 * size["bytes"] // (16 * BLOCK_WORDS)))
    parts = 1 << max(0, (size["words"] // PART_WINDOWS).bit_length())
    folder = fresh_path(benchmark.sparkSession, "automata")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pairs = [(None if pd.isna(a) else a, None if pd.isna(b) else b) for a, b in zip(rows["item"], rows["text"], strict=True)]
        with written(folder, f"block-{key[0]:06d}") as out:
            out.write(pickle.dumps(ItemAutomaton(pairs), protocol=pickle.HIGHEST_PROTOCOL))
        found = []
        for n, h in windows_of([text for _, text in pairs]):
            found.append(pd.DataFrame({"size": np.int32(n), "hash": h.view(np.int64), "block": np.int32(key[0])}))
        return pd.concat(found) if found else pd.DataFrame({"size": [], "hash": [], "block": []}).astype({"size": np.int32, "hash": np.int64, "block": np.int32})

    def file(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["hash"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(h, kind="stable")
        for name, values in (("hashes", h[order].astype("<u8")), ("blocks", rows["block"].to_numpy(dtype="<i4")[order])):
            with written(folder, f"{name}-{key[0]:06d}") as out:
                out.write(values.tobytes())
        return pd.DataFrame({"part": [key[0]]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(many)))
    windows = cut(dealt.groupBy("block").applyInPandas(build, "size int, hash long, block int"), "windows")
    part = F.shiftrightunsigned("hash", 64 - (parts - 1).bit_length()).cast("int") if parts > 1 else F.lit(0)
    filed = {r["part"] for r in windows.select(part.alias("part"), "hash", "block").groupBy("part").applyInPandas(file, "part int").collect()}
    for k in set(range(parts)) - filed:
        for name in ("hashes", "blocks"):
            with written(folder, f"{name}-{k:06d}") as out:
                out.write(b"")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]
    return Several, (folder, parts, sizes)


def windows_of(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(words, hashes) of the distinct windows of some items, those of WINDOW words and shorter ones by themselves."""
    whole, short = [], {}
    for _, n, data, offsets in text_slices(pa.array(texts, pa.string()), SLICE):
        s = scan(data, offsets, ALNUM)
        hashes = s.hashes()
        h = window_hashes(hashes, WINDOW)
        whole.append(h[s.doc[: len(h)] == s.doc[WINDOW - 1 :][: len(h)]])
        firsts, counts = np.cumsum(s.counts()) - s.counts(), s.counts()
        for k in np.flatnonzero((counts > 0) & (counts < WINDOW)).tolist():
            short.setdefault(int(counts[k]), []).append(window_hashes(hashes[firsts[k] : firsts[k] + counts[k]], int(counts[k])))
    if whole and (h := np.unique(np.concatenate(whole))).size:
        yield WINDOW, h
    for n, found in sorted(short.items()):
        yield n, np.unique(np.concatenate(found))


_MADE = ["n_words", "n_hit", "longest", "items", "cleaned"]


def contamination(docs: DataFrame, benchmark: DataFrame, clean: bool = False) -> DataFrame:
    """``docs`` with n_words, n_hit, longest (longest match in words), items (ids found, as strings) and cleaned.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A window is ten
    consecutive words of an item, or a whole item of fewer. A word inside an occurrence of a window is hit.
    ``longest`` is the longest match that has a window. ``cleaned`` is the text without its hits (null if it has none, or ``clean`` is false).

    Nulls: a null or empty text has no words and no hits; an item without words is never found; an item with a
    null id hits words but is not listed. Repeated items count once by id; repeated documents are judged
    each. Long texts are taken whole. An empty benchmark hits nothing; an empty table gives an empty table. Columns
    of ``docs`` named like the new ones are replaced, others stay.
    """
    docs = docs.drop(*_MADE)
    shipped = docs.sparkSession.sparkContext.broadcast(matcher_of(benchmark))
    held: list[Only | Several] = []

    def run(batches: Batches) -> Batches:
        kind, given = shipped.value
        matcher = held[0] if held else kind(*given)
        held[:] = [matcher]
        only = isinstance(matcher, Only)
        for rows, data, offsets in row_slices(batches if only else gathered(batches, BLOCKS_SLICE), SLICE if only else BLOCKS_SLICE):
            s = scan(data, offsets, ALNUM)
            hashes = s.hashes()
            found = matcher.finder(s, hashes)(np.arange(len(hashes)), s.doc)
            texts = cleaned(matcher, s, hashes, data, offsets, found) if clean else {}
            n = rows.num_rows
            of = [found.get(d) for d in range(n)]
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns,
                    pa.array(s.counts(), pa.int64()),
                    pa.array([sum(b - a for a, b in f.spans) if f else 0 for f in of], pa.int64()),
                    pa.array([f.longest if f else 0 for f in of], pa.int64()),
                    pa.array([sorted(x for x in f.items if x is not None) if f else [] for f in of], pa.list_(pa.string())),
                    pa.array([texts[d].decode() if d in texts else None for d in range(n)], pa.string()),
                ],
                names=[*rows.schema.names, *_MADE],
            )

    return in_batches(docs, run, with_columns(docs, "n_words long, n_hit long, longest long, items array<string>, cleaned string"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits by benchmark windows."""
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without benchmark passages; documents with half of their words in hits go as a whole.

    Nulls: a document with a null text, or without words, has no hits and stays as it is; a null doc_id is no matter. Repeated rows are
    judged each; an empty table gives an empty one. Columns named like those of :func:`contamination` stay what they were.
    """
    own = set_aside(docs, _MADE)
    found = contamination(docs.withColumnsRenamed(own), benchmark, clean=True).where(F.col("n_hit") < F.greatest(F.col("n_words") * COVERAGE, F.lit(1)))
    kept = [F.col(f"`{own.get(c, c).replace('`', '``')}`").alias(c) if c != "text" else F.coalesce("cleaned", "text").alias("text") for c in docs.columns]
    return found.select(*kept)


#: DuckDB SQL for the same rows.
SQL_OP9 = r"""
WITH dw AS (
  SELECT doc_id, w AS word, i AS pos FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM documents))),
items AS (
  SELECT item_id, ws, least(10, len(ws)) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i FROM items)),
firsts AS (SELECT DISTINCT m, win, split_part(win, ' ', 1) AS word FROM windows),
lists AS (SELECT doc_id, list(word ORDER BY pos) AS ws FROM dw GROUP BY doc_id),
found AS (
  SELECT DISTINCT dw.doc_id, dw.pos, f.m, f.win FROM dw JOIN firsts f ON dw.word = f.word JOIN lists l ON l.doc_id = dw.doc_id
  WHERE array_to_string(l.ws[dw.pos : dw.pos + f.m - 1], ' ') = f.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + m)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (
    SELECT DISTINCT f.doc_id, CAST(w.item_id AS VARCHAR) AS item FROM found f JOIN windows w ON f.win = w.win AND f.m = w.m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.s, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN lists l USING (doc_id) LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
