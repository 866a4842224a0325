"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model's pieces are read from its file (a parameter; the file is never copied). The search goes
over a chunk's positions from left to right, has the pieces that end there from an Aho-Corasick automaton, and keeps one
backpointer a position: the last piece of the best segmentation that ends there. Only positions within the
longest piece can still be left, so only they are kept; whenever the paths that survive in this window
meet in one boundary, the ids before it are committed and forgotten. Memory is bounded by the longest piece, not by
the text. All chunks go through this one search (``codes``); those within the window need no commit.

The shipped model is of the BPE kind, whose best segmentation is the one that its merges make, not the
one with the largest sum of scores. A segmentation is what the merges make exactly if every two
neighbours are what the merges make of their concatenation, so that is the transition's admissibility:
the piece that ends at a position is the one (there is only one) that is admissible after the last
piece of the prefix before it. What follows at a position depends only on the automaton's node and on the last pieces at the
places in which a piece that is not at its end can begin. Such states are remembered (at most CACHE of them), each with the states
that follow it by character (at most four times as many in all), so that a place in a known surrounding is one look-up. For unigram models (``kind="unigram"``) the
transition is the usual largest sum of scores.

Text is prepared as the model says (identity normalisation): a blank in front, blanks written as
U+2581. No piece has a blank after another character, so a run of blanks with the characters up to the
next blank is a chunk of its own. Characters fall into classes that no piece mixes (letters, marks and so on, as the model's
pieces have them); chunks are cut further where the class changes. Ids of short chunks are remembered (at most CACHE of them). A
character without a piece becomes its UTF-8 bytes' pieces.

Defined results: null and empty texts have no ids; U+2581 in a text is decoded as a blank, as the model
cannot tell them apart (``exact`` is false then); repeated rows are encoded alike; extra columns stay, but for those
named ``ids``, ``n_ids`` and ``exact``, which are replaced.
"""

from __future__ import annotations

import itertools
import math
import operator
import os
import re
import sys
import types
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import release, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL = os.environ.get("TEXTSIEVE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
BLANK, CACHE, CACHED_CHARS = "▁", 1 << 18, 40
LARGE = 16  # characters of a class that has chunks of its own
START, OTHER = -2, 1 << 20  # codes: before the text, character without a piece
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[i:i + n]
            i += n


def read_model(path: str) -> tuple[list[tuple[str, float, int]], str]:
    """(piece, score, type) by id, and the kind: bpe or unigram."""
    pieces, kind = [], "unigram"
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = np.frombuffer(own.get(2, b"\0\0\0\0"), dtype="<f4")[0]
            pieces.append((own[1].decode(), float(score), own.get(3, NORMAL)))
        elif number == 2:
            kind = {1: "unigram", 2: "bpe"}.get(dict(_fields(value)).get(3, 1), "other")
    if kind == "other":
        raise ValueError("only unigram and BPE models are supported")
    return pieces, kind


class Step(dict):
    """A state of the search: the piece that ends now on the best path, and the key: the automaton's node and the last pieces at the
    places in which a piece can begin that goes on. Holds the states that follow, by the next character."""

    __slots__ = ("code", "follow", "key", "size")

    def __init__(self, code: int, size: int, key: tuple[int, ...] = (), follow=None):
        self.code, self.size, self.key, self.follow = code, size, key, follow

    def __missing__(self, c: str) -> Step:
        to = self[c] = self.follow(self, c)
        return to


class Known(dict):
    """The ids of chunks as 32-bit numbers; those of usual length are remembered."""

    __slots__ = ("make",)

    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        got = self.make(chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = got
        return got


class Window:
    """What the search keeps: for each place from the last committed boundary on the piece that ends there on the best
    path (its state, which for BPE is all that the search goes on from), and for unigram models the path's score and the trie's node
    of the longest piece or piece's head that ends now."""

    __slots__ = ("node", "path", "total")

    def __init__(self, begin: Step) -> None:
        self.path, self.total, self.node = [begin], [0.0], 0

    def forget(self, committed: int) -> None:
        self.path, self.total = self.path[committed:], self.total[committed:]


class Pieces:
    """The search over one model."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: str):
        self.kind = kind
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, 4, 5)}
        self.score = {p: pieces[i][1] for p, i in self.id.items()}
        self.text = [p for p, _, _ in pieces]
        self.longest = max(map(len, self.id), default=1)
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.least = min(self.score.values(), default=0.0) - 10.0
        surface = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(BLANK, " ").encode() if t in (NORMAL, 4, 5) else " ⁇ ".encode() if t == UNKNOWN else b"" for p, _, t in pieces]
        self.flat = np.frombuffer(b"".join(surface), np.uint8)
        self.width = np.array([len(x) for x in surface], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.width)[:-1]]) if surface else np.zeros(0, np.int64)
        self.below, self.shorter, self.ending, self.depth = self.automaton()
        self.chunks = re.compile(self.classes()).findall
        self.pair: dict[int, bool] = {}  # last piece << 22 | next piece -> whether it is admissible
        self.begin_step = Step(START, 0, (0, START), self.step)
        self.steps: dict[tuple[int, ...], Step] = {}
        self.followed = 0  # how many states are held as following another
        self.ends: dict[int, Step] = {}  # for unigram models, by code
        self.cache = Known(self.chunk)

    def classes(self) -> str:
        """The expression of chunks (with blanks): blanks, and characters of one class. Two characters are of one class if a piece has
        them as neighbours, or by way of others; small classes are taken together, and a character of none is a chunk of its own."""
        of: dict[str, list[str]] = {}
        for p in self.id:
            chars = p.lstrip(BLANK)
            for a, b in itertools.pairwise(chars):
                x, y = of.setdefault(a, [a]), of.setdefault(b, [b])
                if x is not y:
                    x, y = (x, y) if len(x) >= len(y) else (y, x)
                    x += y
                    of.update(dict.fromkeys(y, x))
        own = sorted({id(x): x for x in of.values()}.values(), key=len, reverse=True)
        sets = [x for x in own if len(x) >= LARGE] + [[c for x in own if len(x) < LARGE for c in x]]
        kinds = "|".join([*[f"[{re.escape(''.join(sorted(x)))}]+" for x in sets if x], "[^ ]"])
        return f" +(?:{kinds})?|{kinds}"

    def automaton(self) -> tuple[list[dict], list[int], list[tuple], list[int]]:
        """The pieces' trie for all places at once (Aho and Corasick): of each node the nodes below by character, the node of its
        longest proper ending, the (length, id) of all pieces that end there, the longest first, and its depth."""
        below, shorter, ending, depth = [{}], [0], [()], [0]
        for p, i in self.id.items():
            at = 0
            for c in p:
                if c not in below[at]:
                    below[at][c] = len(below)
                    below.append({})
                    shorter.append(0)
                    ending.append(())
                    depth.append(depth[at] + 1)
                at = below[at][c]
            ending[at] = ((len(p), i),)
        nodes = list(below[0].values())
        for at in nodes:  # in the order of their depths; grows on the way
            for c, to in below[at].items():
                up = shorter[at]
                while up and c not in below[up]:
                    up = shorter[up]
                shorter[to] = below[up].get(c, 0)
                ending[to] += ending[shorter[to]]
                nodes.append(to)
        return below, shorter, ending, depth

    def merges(self, text: str, edge: int = 0) -> list[str]:
        """What the merges make of a short text: the best-scored pair first, the leftmost of equals. With an edge, they end (and
        what they have made is returned) as soon as a piece crosses it."""
        parts, score, none = list(text), self.score.get, -math.inf
        pairs = [score(x + y, none) for x, y in itertools.pairwise(parts)]
        edge -= 1  # the pair that crosses the edge, while it is in no piece
        while pairs:
            best = max(pairs)
            if best == none:
                break
            at = pairs.index(best)
            new = parts[at] + parts[at + 1]
            parts[at:at + 2] = [new]
            if at <= edge:
                if at == edge:
                    break
                edge -= 1
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(new + parts[at + 1], none)
            if at:
                pairs[at - 1] = score(parts[at - 1] + new, none)
        return parts

    def piece(self, code: int) -> str:
        return self.text[code] if code < OTHER else chr(code - OTHER)

    def admissible(self, last: int, code: int) -> bool:
        """Whether the merges make these two pieces of their concatenation (BPE)."""
        if len(self.pair) > CACHE:
            self.pair.clear()
        a, b = self.piece(last) if last != START else "", self.piece(code)
        ok = self.merges(a + b, len(a)) == ([a, b] if a else [b])
        self.pair[last << 22 | code] = ok
        return ok

    def ids_of(self, code: int | str) -> tuple[int, ...]:
        """The ids of a code, or of a piece."""
        if isinstance(code, str):
            code = self.id.get(code, OTHER + ord(code[0]))
        if code < OTHER:
            return (code,)
        return tuple(self.byte[b] for b in chr(code - OTHER).encode()) if self.byte else (self.unknown,)

    def codes(self, blocks: Iterable[str]) -> Iterator[list[int]]:
        """The pieces' codes, in lists, each as soon as it is certain."""
        window = Window(self.begin_step)
        for block in blocks:
            yield self.search(window, block, False)
        yield self.search(window, "", True)

    def after(self, node: int, c: str) -> tuple[int, tuple[tuple[int, int], ...]]:
        """The automaton's node after one more character, and the (length, code) of what ends there."""
        below, shorter = self.below, self.shorter
        to = below[node].get(c)
        while to is None and node:
            node = shorter[node]
            to = below[node].get(c)
        pieces = self.ending[to or 0]
        if not pieces or pieces[-1][0] > 1:  # no piece of this character alone
            pieces = (*pieces, (1, OTHER + ord(c)))
        return to or 0, pieces

    def places(self, node: int) -> list[int]:
        """How far back the places are in which a piece can begin that goes on after this node."""
        out = [0]
        while node:
            if self.below[node]:
                out.append(self.depth[node])
            node = self.shorter[node]
        return out

    def step(self, at: Step, c: str) -> Step:
        """The state that follows (BPE)."""
        node, pieces = self.after(at.key[0], c)
        last = dict(zip(self.places(at.key[0]), at.key[1:], strict=True))
        for size, code in pieces:  # only one path to a place is admissible
            before = last[size - 1]
            ok = self.pair.get(before << 22 | code)
            if self.admissible(before, code) if ok is None else ok:
                break
        apart = self.depth[node] < 2  # no piece has this character and the one before it: what was before does not matter
        key = (node, code, *[START if apart else last[k - 1] for k in self.places(node)[1:]])
        to = self.steps.get(key)
        if self.followed >= 4 * CACHE or to is None and len(self.steps) >= CACHE:
            for x in (self.begin_step, *self.steps.values()):
                x.clear()
            self.steps.clear()
            self.followed, to = 0, None
        if to is None:
            to = self.steps[key] = Step(code, size, key, at.follow)
        self.followed += 1
        return to

    def search(self, w: Window, block: str, ended: bool) -> list[int]:
        """Goes on with the next characters; the codes that are certain now (all, if the text has ended)."""
        longest, path, total, committed, out = self.longest, w.path, w.total, 0, []
        for i in range(0, len(block), longest):
            part = block[i:i + longest]
            if self.kind == "bpe":
                path += itertools.accumulate(part, operator.getitem, initial=path.pop())
            else:
                for c in part:
                    w.node, pieces = self.after(w.node, c)
                    most = None
                    for size, code in pieces:
                        s = total[-size] + (self.score[self.text[code]] if code < OTHER else self.least)
                        if most is None or s > most:
                            most, best, length = s, code, size
                    total.append(most)
                    if best not in self.ends:
                        self.ends[best] = Step(best, length)
                    path.append(self.ends[best])
            end = len(path) - 1
            if end - committed >= 3 * longest:
                common = self._converged(path, committed, end)
                out += self._back(path, common, committed)
                committed = common
        if ended:
            return out + self._back(path, len(path) - 1, committed)
        w.forget(committed)
        return out

    @staticmethod
    def _back(path: list[Step], at: int, stop: int) -> list[int]:
        out = []
        while at > stop:
            s = path[at]
            out.append(s.code)
            at -= s.size
        out.reverse()
        return out

    def _converged(self, path: list[Step], committed: int, end: int) -> int:
        """The last boundary that all paths share that can go on: those to the places in which a piece that ends later can begin."""
        paths = []
        for p in range(max(committed, end + 1 - self.longest), end + 1):
            cuts = []
            while p > committed:
                cuts.append(p)
                p -= path[p].size
            cuts.append(committed)
            paths.append(cuts[::-1])
        common = committed
        for cuts in zip(*paths):  # noqa: B905
            if len(set(cuts)) > 1:
                break
            common = cuts[0]
        return common

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Pieces of the characters, each as soon as it is certain."""
        for codes in self.codes(chars):
            yield from map(self.piece, codes)

    def short(self, chunk: str) -> list[int]:
        """The ids of a chunk that is in memory."""
        if self.kind == "bpe" and len(chunk) < 3 * self.longest:
            out = self._back(list(itertools.accumulate(chunk, operator.getitem, initial=self.begin_step)), len(chunk), 0)
        else:
            out = self.search(Window(self.begin_step), chunk, True)
        if not out or max(out) < OTHER:
            return out
        return [i for c in out for i in self.ids_of(c)]

    def chunk(self, chunk: str) -> bytes:
        return array("i", self.short(chunk.replace(" ", BLANK))).tobytes()

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.chunks(" " + text.replace(BLANK, " ")))) if text else b""

    def surfaces(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids' pieces, and where each piece's end."""
        width = self.width[ids]
        ends = np.cumsum(width)
        return self.flat[np.repeat(self.begin[ids] - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)], ends

    def decode(self, ids: np.ndarray) -> str:
        out = self.surfaces(np.asarray(ids, dtype=np.int64))[0].tobytes().decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def kept(name: str, make):
    """One object for each Python worker, whatever number of tasks it runs (this module is shipped with each)."""
    home = sys.modules.setdefault("textsieve_worker", types.ModuleType("textsieve_worker"))
    if getattr(home, "name", None) != name:
        home.name, home.value = name, make()
    return home.value


def same(own: Pieces, ids: np.ndarray, offsets: np.ndarray, texts: list[str | None], step: int = 1 << 20) -> list[bool]:
    """Whether decoding each text's ids gives the text back; some ids at a time, a long text by itself in parts."""
    out, i = [], 0
    while i < len(texts):
        to = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        data, ends = [], []
        for at in range(int(offsets[i]), int(offsets[to]), step):
            part, own_ends = own.surfaces(ids[at:min(at + step, int(offsets[to]))].astype(np.int64))
            ends.append(own_ends + sum(map(len, data)))
            data.append(part.tobytes())
        whole, cuts = b"".join(data), np.concatenate([[0], *ends])[offsets[i:to + 1] - offsets[i]]
        for j, t in enumerate(texts[i:to]):
            out.append(whole[cuts[j]:cuts[j + 1]] == (" " + t).encode() if t else cuts[j] == cuts[j + 1])
        i = to
    return out


def load(path: str = MODEL) -> Pieces:
    return Pieces(*read_model(path))


def encode(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """Adds ids (array<int>), n_ids, and exact: whether decoding the ids gives the text back."""
    pieces, kind = read_model(model)
    check_chunks(pieces)
    name = f"{model}:{hash(tuple(pieces))}"
    shared = docs.sparkSession.sparkContext.broadcast((pieces, kind))
    fields = [f for f in docs.schema.fields if f.name not in ("ids", "n_ids", "exact")]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_ids", T.LongType()), T.StructField("exact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(name, lambda: Pieces(*shared.value))
        for whole in batches:
            texts = whole.column(whole.schema.get_field_index(text))
            at = 0
            while at < whole.num_rows:  # a few MB of text at a time, whatever the batch
                size, to = 0, at
                while to < whole.num_rows and (size < 4 << 20 or to == at):
                    size += len(texts[to].as_buffer() or b"") if texts[to].is_valid else 0
                    to += 1
                part = whole.slice(at, to - at)
                values = texts.slice(at, to - at).to_pylist()
                coded = [own.encode(t) for t in values]
                counts = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                ids = np.frombuffer(b"".join(coded), dtype="<i4")
                exact = same(own, ids, offsets, values)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                columns = [part.column(part.schema.get_field_index(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(counts), pa.array(exact)], names=[*[f.name for f in fields], "ids", "n_ids", "exact"])
                at = to
        release()

    return docs.mapInArrow(run, schema)


def check_chunks(pieces: list[tuple[str, float, int]]) -> None:
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _, t in pieces if t in (NORMAL, 4, 5)):
        raise ValueError("a piece has a blank after another character; chunks would not be independent")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_ids", "ids", "exact")
