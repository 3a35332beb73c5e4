"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation of a text is the one with the greatest sum of piece scores. Only the last L scores matter, L being
the longest piece: whatever follows begins at one of the last L boundaries. So the search reads a window, follows the back
pointers of those L boundaries until all of them run through one, and commits the ids before it; the next window begins there.
Where they don't meet inside the window, it is read again with twice the length. So memory depends on how far rival paths
run apart, not on the text.

Many stretches of text are searched side by side, a window of each at a time. A stretch ends where all paths are known to
meet, whatever the scores: where no piece can span a boundary, such as before a word mark that follows another character
(if the vocabulary has no piece with a mark inside), or beside a character that is in no longer piece. Equal stretches
have equal ids, so each different one of some megabytes of text is searched once, without a Python object for any of them.

A character that no piece covers becomes its UTF-8 bytes' pieces (or the unknown piece). The vocabulary is read by the
driver and sent to the tasks; its size has nothing to do with the data. Scores are the model file's log probabilities if it
is a unigram model. A BPE model has merge ranks instead, which add up to nothing sensible; rank r is read as the log
probability that Zipf's law gives it, with a price for each piece. The best sum is then mostly, not always, what merging
would give.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_slices, small_batches

MARK = "▁"


class Vocabulary:
    """Pieces with their scores and ids, the ids of bytes, and the longest piece's code points."""

    def __init__(self, pieces: list[tuple[str, float, int]], byte_ids: dict[int, int], unknown: int):
        self.pieces = {p: (s, i) for p, s, i in pieces}
        self.byte_ids, self.unknown = byte_ids, unknown
        self.longest = max(map(len, self.pieces), default=1)
        self.penalty = min((s for s, _ in self.pieces.values()), default=0.0) - 10.0
        #: No piece has a mark after another character: then paths always meet before such a mark.
        self.parted = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        #: ASCII characters that are in no longer piece: paths meet on both sides of one.
        self.alone = sorted(set(map(chr, range(128))) - {c for p in self.pieces if len(p) > 1 for c in p} - {" "})
        #: For each id the bytes that it stands for, marks as spaces.
        known = {i: p.replace(MARK, " ").encode() for p, (_, i) in self.pieces.items()} | {i: bytes([b]) for b, i in byte_ids.items()} | {unknown: " ⁇ ".encode()}
        self.bytes_of = [known.get(i, b"") for i in range(max(known) + 1)]

    @staticmethod
    def read(path: str) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        plain = [(m.id_to_piece(i), m.get_score(i), i) for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        if all(s == int(s) <= 0 for _, s, _ in plain):
            plain = [(p, -math.log(1 - s) - 5.0, i) for p, s, i in plain]
        return Vocabulary(plain, {int(m.id_to_piece(i)[1:-1], 16): i for i in every if m.is_byte(i)}, m.unk_id())

    def digest(self) -> str:
        """Equal for equal vocabularies, so that a worker keeps its encoder from one query to the next."""
        return hashlib.sha256(repr((sorted(self.pieces.items()), sorted(self.byte_ids.items()), self.unknown)).encode()).hexdigest()

    def fallback(self, character: str) -> tuple[int, ...]:
        data = character.encode()
        return tuple(self.byte_ids[b] for b in data) if all(b in self.byte_ids for b in data) else (self.unknown,)


class _Table:
    """Numbers by keys (non-negative, each once), many of which are looked up at a time; 0 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.keys, self.values = np.uint64(64 - bits), np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):  # each goes to the first free place from its own on
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several the last
            here = self.keys[at] == keys[left]
            self.values[at[here]] = values[left[here]]
            left, at = left[~here], (at[~here] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], 0)
        left = np.flatnonzero((held != keys) & (held >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            held = self.keys[at]
            same, more = held == keys[left], held >= 0
            out[left[same]] = self.values[at[same]]
            more &= ~same
            left, at = left[more], at[more]
        return out


class Search:
    """The streaming search for many stretches side by side."""

    def __init__(self, v: Vocabulary, window: int = 256):
        self.v, self.window = v, max(window, 2 * v.longest)
        nodes, scores, ids = {}, [-math.inf], [-1]  # the trie: (node, character) -> node, and what a node ends
        for piece, (score, i) in v.pieces.items():
            at = 0
            for c in piece:
                key = at << 21 | ord(c)
                if key not in nodes:
                    nodes[key] = len(scores)
                    scores.append(-math.inf), ids.append(-1)
                at = nodes[key]
            scores[at], ids[at] = score, i
        self.edges = _Table(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.ids, self.scores = np.array(ids, np.int64), np.array(scores)
        self.scores[0] = v.penalty  # node 0: no piece, the character as bytes

    def __call__(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stretches, one after another, and where each one's start (with the end of the last)."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        return self.side_by_side(np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), np.uint32), sizes)

    def side_by_side(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for stretches that are given by their characters, one after another, and their sizes."""
        chars = chars.astype(np.int64)
        starts, stops = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        at, width, open_ = starts.copy(), np.full(len(sizes), self.window), np.flatnonzero(sizes)
        owners, found = [], []
        while len(open_):
            end = np.minimum(at[open_] + width[open_], stops[open_])
            of, ids, met = self._window(chars, at[open_], end, end == stops[open_])
            owners.append(open_[of]), found.append(ids)
            stuck = met == at[open_]
            width[open_[stuck]] *= 2
            width[open_[~stuck]] = self.window
            at[open_] = met
            open_ = open_[met < stops[open_]]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")  # windows come in turn, so a stretch's ids keep their order
        ids = np.concatenate(found)[order] if found else owner
        return ids, np.append(0, np.cumsum(np.bincount(owner, minlength=len(sizes))))

    def _window(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows [begin, end) of text, whole: nothing follows: (window, id) of the pieces that are certain, in order, and how far they reach."""
        sizes = end - begin
        first = np.cumsum(sizes + 1) - (sizes + 1)  # a place for every boundary of every window
        lane = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(lane)) + lane  # the place before each character
        chars = text[np.arange(len(lane)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)]
        last = (first + sizes)[lane]
        # All pieces that fit anywhere: from every character down the trie, all at once.
        source, char, node, arcs = start, np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        while len(char):
            node = self.edges(node << 21 | chars[char])
            on = np.flatnonzero(node)  # no edge leads to the root
            source, char, node = source[on], char[on] + 1, node[on]
            done = np.flatnonzero(self.ids[node] >= 0)
            place = start[char - 1] + 1
            arcs.append((source[done], place[done], node[done]))
            more = np.flatnonzero(place < last[char - 1])
            source, char, node = source[more], char[more], node[more]
        # The longest first: of one boundary's arcs, what comes first begins first.
        arcs = [*arcs[::-1], (start, start + 1, np.zeros(len(start), np.int64))]
        source, to, node = (np.concatenate([a[k] for a in arcs]) for k in range(3))
        depth = np.arange(len(chars) + len(sizes)) - np.repeat(first, sizes + 1)  # characters before each place
        far = depth[to]
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")  # small numbers are sorted in linear time
        source, to, node = source[order], to[order], node[order]
        score = self.scores[node]
        best, back, how = np.full(len(depth), -np.inf), np.arange(len(depth)), np.zeros(len(depth), np.int64)
        best[first] = 0.0
        level = np.append(np.flatnonzero(np.diff(depth[to], prepend=-1)), len(to))
        for lo, hi in zip(level[:-1], level[1:], strict=True):  # boundaries at the same distance from their window's begin
            total = best[source[lo:hi]] + score[lo:hi]
            np.maximum.at(best, to[lo:hi], total)
            win = np.flatnonzero(total == best[to[lo:hi]])[::-1] + lo  # of equals the first: the longer last piece
            back[to[win]], how[to[win]] = source[win], node[win]
        # Where the paths of the last boundaries meet; of a window that nothing follows, the end itself.
        meet = first + sizes
        rest = np.flatnonzero(~whole)
        if len(rest):
            heads = np.minimum(self.v.longest, sizes[rest] + 1)
            places = np.concatenate([np.arange(m - h + 1, m + 1) for m, h in zip(meet[rest], heads, strict=True)])
            through = np.zeros(len(depth), np.int64)
            through[places] = 1
            inside = np.flatnonzero(np.repeat(np.isin(np.arange(len(sizes)), rest), sizes + 1) & (depth > 0))
            inside = inside[np.argsort(-depth[inside], kind="stable")]
            for some in np.split(inside, np.flatnonzero(np.diff(depth[inside])) + 1):
                np.add.at(through, back[some], through[some])
            common = np.flatnonzero(through == np.repeat(np.where(whole, -1, self.v.longest), sizes + 1))
            meet[rest] = first[rest]
            np.maximum.at(meet, np.searchsorted(first, common, "right") - 1, common)
        # Back from there; the boundaries that are met, in order of place, are the ends of the pieces.
        here, ends = meet[meet > first], [np.zeros(0, np.int64)]
        while len(here):
            ends.append(here)
            here = back[here]
            here = here[depth[here] > 0]
        ends = np.sort(np.concatenate(ends))
        ids, of = self.ids[how[ends]], np.searchsorted(first, ends, "right") - 1
        bare = np.flatnonzero(ids < 0)
        if len(bare):  # characters as bytes: one id becomes several
            instead = [self.v.fallback(chr(c)) for c in chars[ends[bare] - 1 - of[bare]]]
            many = np.ones(len(ids), np.int64)
            many[bare] = [len(x) for x in instead]
            out, at = np.repeat(ids, many), np.cumsum(many) - many
            for k, x in zip(at[bare].tolist(), instead, strict=True):
                out[k : k + len(x)] = x
            ids, of = out, np.repeat(of, many)
        return of, ids, begin + (meet - first)


def _pick(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `at` of those that lie in values between ends, one after another, and their lengths."""
    n = (ends[1:] - ends[:-1])[at]
    return values[np.arange(int(n.sum())) + np.repeat(ends[:-1][at] - (np.cumsum(n) - n), n)], n


class Encoder:
    """Encodes whole texts with one vocabulary. Stretches of about `most` bytes together are searched at a time, so that working copies stay small."""

    def __init__(self, v: Vocabulary, most: int = 200_000, window: int = 256):
        self.v, self.most, self.search = v, most, Search(v, window)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The stretches of all texts, with spaces for marks, and how many each text has."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        new = np.zeros(len(data) + 1, bool)
        new[at] = True
        if self.v.parted:
            space = data == 32
            new[1:-1] |= space[1:] & ~space[:-1]
        alone = np.isin(data, np.array([ord(c) for c in self.v.alone], np.uint8))
        new[:-1] |= alone
        new[1:] |= alone
        new[-1] = False
        begins = np.flatnonzero(new)
        of = np.bincount(np.searchsorted(at, begins, "right") - 1, minlength=len(texts))
        offsets = pa.py_buffer(np.append(begins, len(data)))
        return pa.Array.from_buffers(pa.large_string(), len(begins), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]), of

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (some megabytes together), one after another, and how many each has."""
        stretches, of = self._cut(texts)
        if not len(stretches):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = stretches.dictionary_encode()
        at = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
        data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)[: at[-1]]
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        chars[chars == 32] = ord(MARK)
        upto = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]  # code points before each stretch
        found, sizes, first = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
        while first < len(at) - 1:
            last = max(first + 1, int(np.searchsorted(at, at[first] + self.most, "right")) - 1)
            ids, ends = self.search.side_by_side(chars[upto[first] : upto[last]], np.diff(upto[first : last + 1]))
            found.append(ids.astype(np.int32)), sizes.append(np.diff(ends))
            first = last
        out, each = _pick(np.concatenate(found), np.cumsum(np.concatenate(sizes)), coded.indices.to_numpy(zero_copy_only=False))
        ends = np.append(0, np.cumsum(each))
        return out, np.diff(ends[np.append(0, np.cumsum(of))])

    def __call__(self, text: str | None) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()


#: The encoder of this Python worker, with the vocabulary that it is for: tasks that follow each other share it.
_WORKER: list[tuple[object, Encoder]] = []


def _encoder(key: object, vocabulary) -> Encoder:
    if not _WORKER or _WORKER[0][0] != key:
        _WORKER.clear()  # the former one goes before the new one is made
        _WORKER.append((key, Encoder(vocabulary())))
    return _WORKER[0][1]


def decode(ids: pa.Array, v: Vocabulary) -> pa.Array:
    """The texts of lists of ids; bytes that aren't UTF-8 become U+FFFD, ids of no text nothing, unknown pieces U+2047."""
    lists = pc.if_else(pc.is_valid(ids), ids, pa.scalar([], ids.type))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pieces = pa.array([*v.bytes_of, b""], pa.large_binary()).take(pa.array(np.where((flat >= 0) & (flat < len(v.bytes_of)), flat, len(v.bytes_of))))
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]  # the pieces lie one after another: a text is a range of them
    data = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(offsets[ends])), pieces.buffers()[2]])
    try:
        texts = data.cast(pa.large_string())
    except pa.ArrowInvalid:
        texts = pa.array([x.as_py().decode("utf-8", "replace") for x in data], pa.large_string())
    return pc.replace_substring_regex(texts, r"\A ", "", max_replacements=1).cast(pa.string())


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of docs, with ids (array of int) and n_ids; columns of these names are replaced.

    A text gets a space before it, and spaces become word marks, as the public models expect. Null and empty texts have no
    ids. Repeated rows are encoded alike. However long a text, its pending state stays small; its ids are one array.
    """
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.read(model_path)
    shared, key = docs.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.digest()

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        encoder = _encoder(key, lambda: shared.value)
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for _, part in in_slices(texts, 3 << 20):
            found, n = encoder.encode(part)
            ids.append(found), sizes.append(n)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))

    # Said to be non-deterministic, so that Spark doesn't repeat the search for each later use of the ids.
    return docs.withColumn("ids", ids_of.asNondeterministic()(text_col)).withColumn("n_ids", F.size("ids").cast("long"))


def decode_documents(encoded: DataFrame, model_path: str, to_col: str = "decoded") -> DataFrame:
    """All columns, with the text of ids in `to_col`: the encoded text again, but that U+2581, which is the word mark, comes back as a space. Null or no ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model_path))

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        out, at = [pa.array([], pa.string())], 0
        while at < len(ids):  # about 260,000 ids at a time, or one text's
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), "right")))
            out.append(decode(ids.slice(at, end - at), shared.value))
            at = end
        return pa.concat_arrays(out)

    return encoded.withColumn(to_col, text_of("ids"))
