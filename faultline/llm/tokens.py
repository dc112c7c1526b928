"""Token counts and ids of whole texts under a public byte-level vocabulary.

Counting looks every pre-token up twice: in a broadcast table of the lengths of frequent pre-tokens, then in a
cache of the worker; only what both miss is encoded, once per batch of texts. Pre-tokens never travel: each task
reports just its most frequent words, and the sums of these bounded reports give the table. The table decides the
speed alone; a pre-token that it lacks is counted by the library.

Defined results: null counts as empty, with no tokens; a special token's text inside a document is that one
token, as the library has it by default; ids, ties and repeated rows pass through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
LIMIT = 512
TASK_WORDS = 4096  # reported by a task
TABLE_WORDS = 65_536  # in the broadcast table
CACHE = 300_000  # entries of a worker's cache
COUNTED_WORDS = 500_000  # words a task counts at a time
CHUNK = 4_000_000  # characters of text handled at a time

# fixed values: the vocabulary's rule for parting texts, in the order it tries the branches; white space as the
# library's expressions have it, without the four separators U+001C to U+001F
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# a blank that does not simply lead the next word
_ODD_BLANK = re.compile(r" (?:\s|\Z)")


class Vocabulary:
    """One per worker: the library's encoder, its special tokens, and what was encoded before."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")
        self.lengths: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}
        self._name, self._core, self._ids = name, None, {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}

    def count(self, texts: list[str], frequent: dict[str, int]) -> list[int]:
        """Tokens of each text."""
        split, missing = [], set()
        for text in texts:
            parts = self.special.split(text)
            tokens = [t for p in parts for t in PRE_TOKEN.findall(p)]
            split.append((len(parts) - 1, tokens))
            missing.update(tokens)
        missing = [t for t in missing if t not in frequent and t not in self.lengths]
        if len(self.lengths) + len(missing) > CACHE:
            # what this batch still needs is encoded again below
            self.lengths.clear()
            missing = list({t for _, tokens in split for t in tokens if t not in frequent})
        for token, coded in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False), strict=True):
            self.lengths[token] = len(coded.ids)
        known, cached = frequent.get, self.lengths.__getitem__
        return [n + sum([known(t) or cached(t) for t in tokens]) for n, tokens in split]

    def encode(self, word: str) -> bytes:
        """Ids of a text without special tokens as little-endian 32-bit numbers.

        The same vocabulary through the faster of the two libraries; tests hold both against each other.
        """
        if self._core is None:
            import base64

            import public_tokenizers
            import tiktoken

            with open(public_tokenizers.path(f"{self._name}.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        ids = self._core.encode_ordinary(word)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, special tokens included, joined from those of its words.

        A word takes the blank before it along, so cutting before single blanks never cuts a pre-token; texts
        with other white space after a blank, or a blank at the end, are encoded whole.
        """
        out, at = [], 0
        for special in [*self.special.finditer(text), None]:
            part = text[at : special.start() if special else len(text)]
            if part:
                out.append(self._plain(part))
            if special:
                out.append(self._ids[special.group()].to_bytes(4, "little"))
                at = special.end()
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if _ODD_BLANK.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        pieces = self.pieces
        found = list(map(pieces.get, rest))
        if None in found:
            if len(pieces) > CACHE:
                pieces.clear()
            for k, word in enumerate(rest):
                if found[k] is None:
                    piece = pieces.get(word)
                    if piece is None:
                        piece = pieces[word] = self.encode(" " + word)
                    found[k] = piece
        return (self.encode(first) if first else b"") + b"".join(found)


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(name: str) -> Vocabulary:
    if name not in _vocabularies:
        _vocabularies[name] = Vocabulary(name)
    return _vocabularies[name]


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in runs of about CHUNK characters, null as empty, so that memory follows neither batch nor table."""
    run, held = [], 0
    for text in texts:
        run.append(text or "")
        held += len(run[-1])
        if held >= CHUNK:
            yield run
            run, held = [], 0
    if run:
        yield run


def _task_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's most frequent words; counts of rare ones are dropped whenever too many are held."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update((text or "").split(" ")[1:])
            if len(counts) > COUNTED_WORDS:
                counts = Counter(dict(counts.most_common(COUNTED_WORDS // 4)))
    top = [(w, n) for w, n in counts.most_common(4 * TASK_WORDS) if w.isalpha()][:TASK_WORDS]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])


def frequent_lengths(docs: DataFrame, name: str) -> dict[str, int]:
    """Token counts of the corpus' frequent pre-tokens: at most TABLE_WORDS entries, whatever its size."""
    seen = docs.select("text").mapInArrow(_task_words, "word string, n bigint")
    top = seen.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(TABLE_WORDS)
    words = [" " + row.word for row in top.collect()]
    encoder = vocabulary(name).tokenizer
    return {w: len(c.ids) for w, c in zip(words, encoder.encode_batch(words, add_special_tokens=False), strict=True)}


def count_tokens(docs: DataFrame, name: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, name))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [n for run in chunks(batch.column("text").to_pylist()) for n in vocabulary(name).count(run, table.value)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    flat = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = flat.mapInArrow(counted, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
