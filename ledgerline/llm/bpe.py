"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The automaton reads tokens. It begins as one state with an arc for every byte, which takes any text byte by byte. Each merge (u, v) -> w then puts
its gadget in, in the order of the merges: wherever u and then v could be read, w leads where v led, and the state behind u is copied without its arc v, as u and v may
no longer stand side by side (nor u and w, if u = v, as the merge goes from left to right). What is left in the end takes exactly the sequences to which no
merge applies any more; of a text's spellings in tokens it takes one, and so it does of every prefix.

The state that an arc leads to depends on the token alone, so a state is the set of tokens that it has no arc for. A token w = uv is missing in a state as soon as u was when w
was made. Tokens are numbered by a walk through the tree in which w hangs below u, latest first: what one gadget takes away, with all that hangs below it since, is then one
interval of numbers, and a state is a short sorted list of intervals.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond so many distinct words a task forgets those it knows.
KEPT = 1 << 19
#: Characters of words that are encoded together.
TOGETHER = 1 << 20
#: Rows that are read and passed on at a time.
ROWS = 500


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Automaton:
    """Token t has the label labels[t], the number place[t] and leads to state after[t]. With `span` numbers, state s lacks token t if s * span + place[t] is from begins[i] up to ends[i] for some i; state 0 lacks none.

    The labels of state 0 are a trie besides, in which node n goes on with byte b to targets[i] where steps[i] = n * 256 + b, and found[n] is the token that ends there, or -1.
    """

    labels: list[bytes]
    place: np.ndarray
    after: np.ndarray
    span: int
    begins: np.ndarray
    ends: np.ndarray
    steps: np.ndarray
    targets: np.ndarray
    found: np.ndarray
    added: dict[str, int]

    def _arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc for the token beside it."""
        key = state * self.span + self.place[token]
        i = np.searchsorted(self.begins, key, "right") - 1
        return (i < 0) | (key >= self.ends[i])

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's tokens as little-endian numbers of 32 bits: the labels along the only path that spells it.

        All words are read side by side, a byte at a time. Of a position one token is known that ends there on a path from the word's start, and so the state; every arc from there is noted where it ends.
        """
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size) - size
        stop, last, state = start + size, np.full(len(data) + 1, -1, np.int64), np.zeros(len(data) + 1, np.int64)
        order = np.argsort(-size, kind="stable")  # the words that go on come first
        lengths = -size[order]
        for i in range(int(size.max(initial=0))):
            own = order[: np.searchsorted(lengths, -i, "left")]
            at, end, node = start[own] + i, stop[own], np.zeros(len(own), np.int64)
            # the state of a word's first byte is 0, also where another word ends right before
            here = state[at] if i else np.zeros(len(own), np.int64)
            to = at
            while len(at):
                key = node * 256 + data[to]
                k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
                on = self.steps[k] == key
                at, end, here, to, node = at[on], end[on], here[on], to[on] + 1, self.targets[k[on]]
                token = self.found[node]
                ends = np.flatnonzero(token >= 0)
                ends = ends[self._arcs(here[ends], token[ends])]
                last[to[ends]], state[to[ends]] = token[ends], self.after[token[ends]]
                on = to < end
                at, end, here, to, node = at[on], end[on], here[on], to[on], node[on]
        return self._paths(last, start, stop)

    def _paths(self, last: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """From the tokens that end at each position the path of each word, from its end back."""
        lengths = np.array([len(x) for x in self.labels], np.int64)
        word, at, rounds = np.flatnonzero(stop > start), stop[stop > start], []
        while len(word):
            token = last[at]
            rounds.append((word, token))
            at = at - lengths[token]
            on = at > start[word]
            word, at = word[on], at[on]
        if not rounds:
            return [b""] * len(start)
        words, tokens = np.concatenate([w for w, _ in reversed(rounds)]), np.concatenate([t for _, t in reversed(rounds)])
        by_word = np.argsort(words, kind="stable")
        flat, cuts = tokens[by_word].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(words, minlength=len(start)))).tolist()
        return [flat[a:z] for a, z in zip([0, *cuts], cuts, strict=False)]


def compile_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None) -> Automaton:
    """The automaton of a byte-level vocabulary. Every byte must be a token, and every merge must make a new token of two that are there already; another vocabulary is an error."""
    letters = byte_letters()
    if gone := [c for c in letters if c not in vocabulary]:
        raise ValueError(f"{len(gone)} bytes are no tokens")
    size = max([*vocabulary.values(), *(added or {}).values()]) + 1
    born = {c: -1 for c in letters}  # token -> the merge that makes it
    below: dict[str, list[str]] = {}
    for k, (u, v) in enumerate(merges):
        if u not in born or v not in born or u + v in born or u + v not in vocabulary:
            raise ValueError(f"merge {k} doesn't make a new token of two that are there already")
        born[u + v] = k
        below.setdefault(u, []).append(u + v)
    place, end = _numbered(list(letters), below)
    node: dict[str, tuple | None] = dict.fromkeys(letters)  # token -> the state it leads to: the intervals that it lacks, the latest first
    dead: set[str] = set()
    for k, (u, v) in enumerate(merges):
        w = u + v
        node[w] = node[v]
        if u in dead or v in dead or _lacks(node[u], place[v]):
            dead.add(w)
            continue
        older = next((x for x in reversed(below.get(v, [])) if born[x] < k), None)  # what hangs below v from here on comes before it
        node[u] = (place[v], place[older] if older else end[v], node[u])
    states: dict[int, int] = {id(None): 0}
    span, begins, ends = len(place) + 1, [], []
    after, numbers, labels = np.zeros(size, np.int64), np.zeros(size, np.int64), [b""] * size
    for text in born:
        n, token = node[text], vocabulary[text]
        if id(n) not in states:
            at = states[id(n)] = len(states)
            for a, z in _flat(n):
                begins.append(at * span + a)
                ends.append(at * span + z)
        after[token], numbers[token], labels[token] = states[id(n)], place[text], bytes(map(letters.__getitem__, text))
    for text, token in (added or {}).items():
        labels[token] = text.encode()
    return Automaton(labels, numbers, after, span, np.array(begins, np.int64), np.array(ends, np.int64), *_trie({labels[vocabulary[t]]: vocabulary[t] for t in born if t not in dead}), dict(added or {}))


def _trie(tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes: dict[bytes, int] = {b"": 0}
    for label in tokens:
        for i in range(1, len(label) + 1):
            nodes.setdefault(label[:i], len(nodes))
    found, steps = np.full(len(nodes), -1, np.int64), np.zeros(len(nodes) - 1, np.int64)
    for label, n in nodes.items():
        found[n] = tokens.get(label, -1)
        if label:
            steps[n - 1] = nodes[label[:-1]] * 256 + label[-1]
    order = np.argsort(steps)
    return steps[order], order + 1, found


def _numbered(roots: list[str], below: dict[str, list[str]]) -> tuple[dict[str, int], dict[str, int]]:
    """Each token's number in a walk that goes to the latest child first, and the number behind all that hang below it."""
    place: dict[str, int] = {}
    end: dict[str, int] = {}
    todo = [(t, False) for t in reversed(roots)]
    while todo:
        token, left = todo.pop()
        if left:
            end[token] = len(place)
            continue
        place[token] = len(place)
        todo.append((token, True))
        todo.extend((t, False) for t in below.get(token, ()))  # the last is taken first
    return place, end


def _lacks(node: tuple | None, number: int) -> bool:
    while node:
        if node[0] <= number < node[1]:
            return True
        node = node[2]
    return False


def _flat(node: tuple | None) -> list[tuple[int, int]]:
    """A state's intervals, sorted and joined where they touch."""
    found = []
    while node:
        found.append(node[:2])
        node = node[2]
    out: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


@lru_cache(4)
def read_automaton(path: str) -> Automaton:
    """From a tokenizer's JSON file with a byte-level BPE model, no normalizer and added tokens that are found as they stand."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    model, how = config["model"], config.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or how.get("type") != "ByteLevel" or how.get("add_prefix_space") or not how.get("use_regex", True) or config.get("normalizer"):
        raise ValueError(f"{path} is no plain byte-level BPE")
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) or any(t.get(x) for t in config.get("added_tokens", []) for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} has options that the automaton doesn't know")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return compile_merges(model["vocab"], merges, {t["content"]: t["id"] for t in config.get("added_tokens", [])})


class Words(dict):
    """The tokens of words that were met before; what is held is bounded."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def learn(self, words: set[str]) -> None:
        """Make the tokens of all the words known."""
        if len(self) > KEPT:
            self.clear()
        new = sorted(words - self.keys())
        at = 0
        while at < len(new):  # so many bytes at a time
            to, size = at, 0
            while to < len(new) and size < TOGETHER:
                size += len(new[to])
                to += 1
            self.update(zip(new[at:to], self.automaton.encode([w.encode() for w in new[at:to]]), strict=True))
            at = to


def splitter() -> Callable[[str], list[str]]:
    """From a text to the words within which tokens are merged. Texts of characters below U+0590 are cut by classes listed for them, which is faster; others by their Unicode properties."""
    import regex

    near_end, classes = 0x590, {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
    listed = {k: "".join(re.escape(c) for c in map(chr, range(near_end)) if regex.match(p, c)) for k, p in classes.items()}

    # Fixed value: the pattern by which the vocabulary's texts are cut. L, N and S stand for the insides of classes of letters, numbers and white space.
    def pattern(L: str, N: str, S: str) -> str:  # noqa: N803
        return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"

    near, far, beyond = re.compile(pattern(**listed)).findall, regex.compile(pattern(**classes)).findall, re.compile(f"[^\0-{chr(near_end - 1)}]").search
    return lambda text: far(text) if beyond(text) else near(text)


def encode_texts(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens) for every row of docs: the tokens of its whole text, as little-endian numbers of 32 bits one after the other.

    path: the tokenizer's JSON file, read by the driver; what is sent to the tasks is bounded by the vocabulary. Null and empty texts have no tokens; added tokens that stand in a text are found as the
    file has them. Words of any length are read in time proportional to it. Repeated rows are all returned; columns of docs beside doc_id and the text don't matter."""
    shared = docs.sparkSession.sparkContext.broadcast(read_automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cut, added = Words(shared.value), splitter(), shared.value.added
        fixed = {t: i.to_bytes(4, "little") for t, i in added.items()}
        # the longest of added tokens that begin at one place counts
        special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def pieces(text: str | None) -> list[list[str]]:
            """Words of ordinary text and added tokens by turns."""
            if not text:
                return []
            if special is None or not special.search(text):
                return [cut(text)]
            return [[p] if i % 2 else cut(p) for i, p in enumerate(special.split(text))]

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = [pieces(t) for t in part.column(1).to_pylist()]
                words.learn(set().union(*(p for text in texts for p in text[::2])))
                found = [b"".join(b"".join(map((fixed if i % 2 else words).__getitem__, p)) for i, p in enumerate(text)) for text in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64())], ["doc_id", "ids", "n_tokens"])

    rows = docs.select("doc_id", F.col(column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens bigint")


def _known(column: pa.Array) -> pa.Buffer | None:
    """Which rows are no nulls, as bits from the first on."""
    return pa.py_buffer(np.packbits(np.asarray(column.is_valid().to_pylist(), bool), bitorder="little")) if column.null_count else None


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(ids, ...) with `decoded` beside its columns: the text that the labels of the tokens' arcs spell. Bytes that are no UTF-8 become U+FFFD; null has no text; numbers without a token are an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_automaton(path).labels)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(shared.value, pa.binary())

        def text(ids: bytes | None) -> str | None:
            return None if ids is None else b"".join(labels.take(pa.array(np.frombuffer(ids, "<u4"))).to_pylist()).decode("utf-8", "replace")

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                own = part.column(names.index("ids"))
                # all rows' labels in one buffer, which is cut where the rows end
                spelt = labels.take(pa.array(np.frombuffer(b"".join(x or b"" for x in own.to_pylist()), "<u4")))
                rows = np.cumsum([0, *(len(x or b"") // 4 for x in own.to_pylist())])
                ends = np.frombuffer(spelt.buffers()[1], np.int32, len(spelt) + 1)[rows] if len(spelt) else np.zeros(len(rows), np.int32)
                decoded = pa.StringArray.from_buffers(len(own), pa.py_buffer(ends.astype(np.int32)), spelt.buffers()[2] or pa.py_buffer(b""), _known(own))
                try:
                    decoded.validate(full=True)
                except pa.ArrowInvalid:  # tokens cut within a character
                    decoded = pa.array(map(text, own.to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")
