"""Byte-pair encoding and decoding with a lexicon automaton (operator 6).

Words here are the pieces that the vocabulary's pattern cuts a text into. The most frequent words of
the corpus, counted over all documents, are merged once, and compiled with their ids into a minimal
acyclic automaton: words share suffixes as well as prefixes, and each arc carries a number, so that
the sum along a word's path is its place in the table of ids. The automaton is one file that tasks
map into memory. Words it doesn't hold are merged from the vocabulary's ranks, many at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import annotate, map_arrow, release, scratch, slices, truncate_lineage

#: Fixed value: the pattern of the byte-level vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern's white space, as Unicode has it (Python's ``\s`` also takes the separators U+001C to U+001F).
SPACE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LEXICON_WORDS = 50_000
KNOWN_WORDS = 1_000_000  # counts a task holds before it adds them up, and hands over when they stay many
TEXT_BYTES = 4_000_000  # of texts looked at together
FAR = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start : start + length]``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


def octets_of(words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(octets, sizes)``: the words' bytes one after the other, and how many each has."""
    if not isinstance(words, pa.Array):
        words = pa.array(words, type=pa.large_binary())
    if not len(words):
        return np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] else np.zeros(0, dtype=np.uint8)
    return data[ends[0]:ends[-1]], np.diff(ends)


class Vocabulary:
    """Symbols, merges and bytes of a tokenizer file of the BPE kind."""

    def __init__(self, text: str):
        parsed = json.loads(text)
        model = parsed["model"]
        ids: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.size = max([*ids.values(), *(t["id"] for t in parsed["added_tokens"])]) + 1
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + suffix] for c in letters], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] if not suffix else ids[a.removesuffix(suffix) + b] for a, b in pairs], dtype=np.int64)
        back = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * self.size
        for token, number in ids.items():
            self.bytes[number] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        for content, number in self.special.items():
            self.bytes[number] = content.encode()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``FAR`` where it is no merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], FAR)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of the words, none of them empty."""
        return self.merge_octets(*octets_of(words))

    def merge_octets(self, octets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)`` of words that lie one after the other; empty ones have no ids.

        Round by round every word merges all places of its best-ranked pair, left to right, until no
        word has a pair left. A merged symbol's own merges rank later, so this is the one-by-one order.
        """
        if not len(octets):
            return np.zeros(0, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        symbols = self.inner[octets]
        ends = np.cumsum(sizes)[sizes > 0]
        symbols[ends - 1] = self.last[octets[ends - 1]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), FAR)
        same = owner[:-1] == owner[1:]
        rank[:-1][same] = self.rank(symbols[:-1][same], symbols[1:][same])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            spread = np.repeat(best, np.diff(np.r_[first, len(symbols)]))
            going = spread < FAR
            if not going.all():
                done_symbols.append(symbols[~going])
                done_owner.append(owner[~going])
                symbols, owner, rank, spread = symbols[going], owner[going], rank[going], spread[going]
                if not len(symbols):
                    break
            hit = rank == spread
            if (hit[1:] & hit[:-1]).any():  # overlapping places, as in aaa: every second one of a run
                places = np.flatnonzero(hit)
                fresh = np.r_[True, np.diff(places) > 1]
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                hit[places[(np.arange(len(places)) - run_start) % 2 == 1]] = False
            places = np.flatnonzero(hit)
            symbols[places] = self.merged[rank[places]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            moved = np.cumsum(stay) - 1
            places = moved[places]
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            beside = np.zeros(len(symbols), dtype=bool)
            beside[places] = True
            beside[places[places > 0] - 1] = True
            near = np.flatnonzero(beside)
            rank[near] = FAR
            inside = near[near < len(symbols) - 1]
            inside = inside[owner[inside] == owner[inside + 1]]
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(sizes))


# ---------------------------------------------------------------------------- the lexicon automaton


def compile_lexicon(words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The automaton file of sorted, distinct, non-empty words with their ids.

    Built word by word in sorted order: once a word leaves the path of the one before, the states
    left behind can't change any more and are replaced by equal states already there.
    """
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    known: dict[tuple, int] = {}
    path, labels = [0], b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            state = path.pop()
            sign = (final[state], tuple(arcs[state].items()))
            arcs[path[-1]][labels[len(path) - 1]] = known.setdefault(sign, state)

    for word in words:
        shared = 0
        top = min(len(word), len(labels))
        while shared < top and word[shared] == labels[shared]:
            shared += 1
        settle(shared)
        for octet in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][octet] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        labels = word
    settle(0)
    # Renumber the states that are left, and give each arc the number of words that come before it.
    order, seen = [0], {0: 0}
    for state in order:
        for target in arcs[state].values():
            if target not in seen:
                seen[target] = len(order)
                order.append(target)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        open_ones = [t for t in arcs[state].values() if t not in below]
        if open_ones:
            stack.extend(open_ones)
        else:
            stack.pop()
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
    keys, targets, numbers = [], [], []
    for number, state in enumerate(order):
        before = int(final[state])
        for octet, target in sorted(arcs[state].items()):
            keys.append(number * 256 + octet)
            targets.append(seen[target])
            numbers.append(before)
            before += below[target]
    parts = [np.array(keys, dtype="<i8"), np.array(targets, dtype="<i8"), np.array(numbers, dtype="<i8"),
             np.array([final[s] for s in order], dtype="<i8"), np.asarray(lengths, dtype="<i8"), np.asarray(ids, dtype="<i8")]
    head = np.array([len(p) for p in parts], dtype="<i8")
    return b"".join(p.tobytes() for p in [head, *parts])


class Lexicon:
    """A compiled lexicon mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, dtype="<i8", mode="r")
        ends = 6 + np.cumsum(whole[:6])
        self.keys, self.targets, self.numbers, self.final, self.lengths, self.ids = (whole[a:b] for a, b in zip([6, *ends[:-1]], ends))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the table of ids, -1 if the lexicon doesn't hold it."""
        return self.find_octets(*octets_of(words))

    def find_octets(self, octets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``find`` of words that lie one after the other."""
        found = np.full(len(sizes), -1, dtype=np.int64)
        if not len(sizes) or not len(self.keys):
            return found
        starts = np.cumsum(sizes) - sizes
        active, state, total = np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        depth = 0
        while len(active):
            ended = sizes[active] == depth
            if ended.any():
                right = ended & (self.final[state] == 1)
                found[active[right]] = total[right]
                active, state, total = active[~ended], state[~ended], total[~ended]
                if not len(active):
                    break
            wanted = state * 256 + octets[starts[active] + depth]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[at] == wanted
            at, active = at[there], active[there]
            state, total = self.targets[at], total[there] + self.numbers[at]
            depth += 1
        return found


# ------------------------------------------------------------------------------------- encoding


def pieces_pattern() -> regex.Pattern:
    return regex.compile(PATTERN.replace(r"[^\s\p{L}", rf"[^{SPACE}\p{{L}}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


#: Marks that a run may end in; with letters before them, such a run needs no pattern to be cut.
MARKS = ".,;:!?*#$%&|()[]{}\"-"


def cut_run(run: str, lead: str, pattern: regex.Pattern) -> list[str]:
    """The words of ``lead`` (nothing or a space) and ``run``."""
    if run.isalpha():
        return [lead + run]
    body = run.rstrip(MARKS)
    return [lead + body, run[len(body):]] if body.isalpha() else pattern.findall(lead + run)


#: For Arrow's regular expressions, whose ``\p{L}`` is what Python calls a letter: a space with white space or
#: nothing behind it (texts without it are cut by the vocabulary's pattern at every space, so that what stands
#: between spaces can be looked up as a whole); a run of letters; letters and then marks.
LOOSE = " (?:[" + regex.sub(r"\\u([0-9a-f]{4})|\\x([0-9a-f]{2})", r"\\x{\1\2}", SPACE) + r"]|\z)"
LETTERS = r"^\p{L}+\z"
ENDING = r"^(?P<body>\p{L}+)(?P<tail>[" + regex.sub(r"([^\w])", r"\\\1", MARKS) + r"]+)\z"


class Cutter:
    """Cuts texts into words with Arrow's kernels; only runs of an unusual make go through the pattern one by one."""

    def __init__(self, special: Iterable[str] = ()):
        self.pattern = pieces_pattern()
        self.special = list(special)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts are cut at every space and hold no special token."""
        other = pc.match_substring_regex(texts, pattern=LOOSE)
        for token in self.special:
            other = pc.or_(other, pc.match_substring(texts, pattern=token))
        return ~other.to_numpy(zero_copy_only=False)

    def runs(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """``(words, of_run, per_run, run_of_piece, offsets)`` of plain texts.

        ``words`` are distinct; ``of_run`` are their places in all distinct runs, ``per_run`` of them each; the
        pieces of text ``i`` are ``run_of_piece[offsets[i]:offsets[i + 1]]``. A text's first piece has no space before it.
        """
        lists = pc.split_pattern(texts, pattern=" ")
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        run_of_piece = coded.indices.to_numpy().astype(np.int64)
        heads = coded.dictionary.take(pa.array(run_of_piece[offsets[:-1]])).dictionary_encode()
        run_of_piece[offsets[:-1]] = len(coded.dictionary) + heads.indices.to_numpy()
        bodies = pa.concat_arrays([coded.dictionary, heads.dictionary])
        leads = [" "] * len(coded.dictionary) + [""] * len(heads.dictionary)
        return *self.words_of_runs(bodies, pa.array(leads, type=bodies.type)), run_of_piece, offsets

    def words_of_runs(self, bodies: pa.Array, leads: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """``(words, of_run, per_run)``: distinct words, the place of each run's words in them, and how many it has."""
        letters = pc.match_substring_regex(bodies, pattern=LETTERS).to_numpy(zero_copy_only=False)
        marked = np.flatnonzero(~letters)
        ending = pc.extract_regex(bodies.take(pa.array(marked)), pattern=ENDING)
        valid = ending.is_valid().to_numpy(zero_copy_only=False)
        one, two, other = np.flatnonzero(letters), marked[valid], marked[~valid]
        ending = ending.filter(pa.array(valid))
        nothing = pa.scalar("", bodies.type)
        joined = pc.binary_join_element_wise(leads, bodies, nothing)
        first = pc.binary_join_element_wise(leads.take(pa.array(two)), ending.field("body").cast(bodies.type), nothing)
        found = [self.pattern.findall(run) for run in joined.take(pa.array(other)).to_pylist()]
        per_run = np.ones(len(bodies), dtype=np.int64)
        per_run[two] = 2
        per_run[other] = list(map(len, found))
        at = np.cumsum(per_run) - per_run
        place = np.empty(int(per_run.sum()), dtype=np.int64)
        place[at[one]] = np.arange(len(one))
        place[at[two]] = len(one) + np.arange(len(two))
        place[at[two] + 1] = len(one) + len(two) + np.arange(len(two))
        rest = per_run[other]
        steps = np.arange(rest.sum())
        place[np.repeat(at[other] - (np.cumsum(rest) - rest), rest) + steps] = len(one) + 2 * len(two) + steps
        listed_words = pa.array([w for ws in found for w in ws], type=bodies.type)
        coded = pa.concat_arrays([joined.take(pa.array(one)), first, ending.field("tail").cast(bodies.type), listed_words]).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy()[place], per_run


class Encoder:
    """Encodes texts; every distinct run and word of the texts given together is looked at once."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.cutter = Cutter(vocabulary.special)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, starts, lengths)`` of distinct words, looked up in the lexicon or merged."""
        octets, sizes = octets_of(words)
        if not self.lexicon:
            ids, lengths = self.vocabulary.merge_octets(octets, sizes)
            return ids, np.cumsum(lengths) - lengths, lengths
        at = self.lexicon.find_octets(octets, sizes)
        held, rest = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        begins = np.cumsum(sizes) - sizes
        ids, merged = self.vocabulary.merge_octets(gather(octets, begins[rest], sizes[rest]), sizes[rest])
        starts, lengths = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        starts[rest], lengths[rest] = len(self.lexicon.ids) + np.cumsum(merged) - merged, merged
        starts[held], lengths[held] = self.lexicon.starts[at[held]], self.lexicon.lengths[at[held]]
        return np.concatenate([self.lexicon.ids, ids]), starts, lengths

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are cut at their spaces."""
        words, of_run, per_run, run_of_piece, offsets = self.cutter.runs(texts)
        ids, starts, lengths = self.words(words)
        run_lengths = lengths[of_run]
        ids = gather(ids, starts[of_run], run_lengths)
        ends = np.r_[0, np.cumsum(run_lengths)][np.r_[0, np.cumsum(per_run)]]
        starts, lengths = ends[:-1], np.diff(ends)
        piece_lengths = lengths[run_of_piece]
        return gather(ids, starts[run_of_piece], piece_lengths), np.diff(np.r_[0, np.cumsum(piece_lengths)][offsets])

    def _other(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that the pattern has to go through, or that hold special tokens."""
        special = self.vocabulary.special
        words, own, per_text = [], [], []
        for text in texts:
            before = len(words)
            for part in self.cutter.cut.split(text) if self.cutter.cut else [text]:
                if part in special:
                    own.append((len(words), special[part]))
                    words.append("")
                else:
                    words.extend(self.cutter.pattern.findall(part))
            per_text.append(len(words) - before)
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        coded = pa.array(words, type=pa.large_string()).dictionary_encode()
        ids, starts, lengths = self.words(coded.dictionary)
        number = coded.indices.to_numpy()
        starts, lengths = starts[number], lengths[number]
        if own:  # special tokens stand behind all other ids
            places, tokens = map(list, zip(*own))
            starts[places], lengths[places] = len(ids) + np.arange(len(own)), 1
            ids = np.concatenate([ids, np.array(tokens, dtype=np.int64)])
        return gather(ids, starts, lengths), np.diff(np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(per_text)]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, lengths)``: the ids of all texts in a row, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        plain = self.cutter.plain(texts)
        if plain.all():
            return self._plain(texts)
        ids, lengths = [], np.zeros(len(texts), dtype=np.int64)
        starts = np.zeros(len(texts), dtype=np.int64)
        done = 0
        for rows, encode in ((np.flatnonzero(plain), self._plain), (np.flatnonzero(~plain), lambda chosen: self._other(chosen.to_pylist()))):
            if len(rows):
                made, n = encode(texts.take(pa.array(rows)))
                ids.append(made)
                starts[rows], lengths[rows] = done + np.cumsum(n) - n, n
                done += len(made)
        return gather(np.concatenate(ids), starts, lengths), lengths


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all texts, summed per task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter()
        held: list[pa.Table] = []

        def add(words: pa.Array, n: np.ndarray | pa.Array) -> None:
            held.append(pa.table({"word": words.cast(pa.large_string()), "n": pa.array(n, type=pa.int64())}))

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from rows.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=100_000)

        for batch in (part for whole in batches for part in slices(whole, 0, TEXT_BYTES)):
            texts = pc.fill_null(batch.column(0).cast(pa.large_string()), "")
            plain = cutter.plain(texts)
            if plain.any():
                words, of_run, per_run, run_of_piece, _ = cutter.runs(texts.filter(pa.array(plain)))
                n = np.repeat(np.bincount(run_of_piece, minlength=len(per_run)), per_run)
                total = np.bincount(of_run, weights=n, minlength=len(words)).astype(np.int64)
                add(words, total)
            for text in texts.filter(pa.array(~plain)).to_pylist():
                counted = pa.array(cutter.pattern.findall(text), type=pa.large_string()).value_counts()
                add(counted.field(0), counted.field(1))
            if sum(map(len, held)) > KNOWN_WORDS:
                held = [summed()]
                if len(held[0]) > KNOWN_WORDS // 2:
                    yield from out(held[0])
                    held = []
        if held:
            yield from out(summed())
        held = []
        release()

    counted = map_arrow(docs.select("text"), "word string, n bigint", run).where("n > 0")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(spark: SparkSession, docs: DataFrame, vocabulary_text: str, size: int = LEXICON_WORDS) -> str:
    """Compile the ``size`` most frequent words of ``docs`` and give the file to the executors; its name.

    ``size`` bounds what comes to the driver; words of equal or nearly equal counts are in or out
    together. Words that are out are merged where they occur, to the same ids. The file is written below ``spark.checkpoint.dir``, and Spark brings it to every executor.
    """
    counted = truncate_lineage(spark, count_words(docs).where("word <> ''"), "words")
    # The least count that leaves no more than ``size`` words, from a short table of count classes.
    place = F.floor(F.log2("n") * 16)
    left, least = size, None
    for row in counted.groupBy(place.alias("place")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("place")).collect():
        left -= row.words
        if left < 0:
            break
        least = row.least
    rows = counted.where(F.col("n") >= least).select("word").collect() if least is not None else []
    words = sorted({r[0].encode() for r in rows})
    content = compile_lexicon(words, *Vocabulary(vocabulary_text).merge(words))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(scratch(spark, "lexicon"), name)
    sink = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        sink.write(content)
    finally:
        sink.close()
    spark.sparkContext.addFile(target.toString())
    return name


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as handle:
        return handle.read()


class Decoder:
    """Texts from ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.lengths = np.fromiter(map(len, vocabulary.bytes), dtype=np.int64, count=vocabulary.size)
        self.flat, self.starts = np.frombuffer(b"".join(vocabulary.bytes), dtype=np.uint8), np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """One text for each run of ``counts`` ids; bytes that are no UTF-8 become U+FFFD."""
        sizes = self.lengths[ids]
        octets = gather(self.flat, self.starts[ids], sizes).tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [octets[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def listed(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(spark: SparkSession, docs: DataFrame, vocabulary_text: str, lexicon_words: int = LEXICON_WORDS, decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>``: the whole text's ids, special tokens in the text included.

    With ``decoded`` also ``decoded string``, the text that the ids come back to. ``vocabulary_text`` is
    the content of the tokenizer file, which is read once on the driver. A null or empty text has no
    ids; repeated rows and extra columns stay; columns of the added names are replaced; an empty table
    gives an empty result (and an empty lexicon).
    """
    name = build_lexicon(spark, docs, vocabulary_text, lexicon_words)
    shared = spark.sparkContext.broadcast(vocabulary_text)
    state: list[tuple[Encoder, Decoder]] = []

    def run(texts: pa.Array) -> list:
        if not state:
            vocabulary = Vocabulary(shared.value)
            state.append((Encoder(vocabulary, Lexicon(SparkFiles.get(name))), Decoder(vocabulary)))
        ids, lengths = state[0][0].encode(texts)
        return [listed(ids, lengths), state[0][1].decode(ids, lengths)] if decoded else [listed(ids, lengths)]

    return annotate(docs, ["text"], "ids array<int>, decoded string" if decoded else "ids array<int>", run, TEXT_BYTES)


def decode(spark: SparkSession, encoded: DataFrame, vocabulary_text: str) -> DataFrame:
    """``encoded`` with ``decoded string`` from its ``ids``.

    Null ids give an empty text, ids outside the vocabulary fail; a column ``decoded`` is replaced.
    """
    shared = spark.sparkContext.broadcast(vocabulary_text)
    state: list[Decoder] = []

    def run(lists: pa.Array) -> list:
        if not state:
            state.append(Decoder(Vocabulary(shared.value)))
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return [state[0].decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)]

    return annotate(encoded, ["ids"], "decoded string", run)
