"""Packing documents into training sequences by lexical retrieval.

Texts become token ids once: distinct words are encoded by the library and kept by each worker, and a text's ids are those of
its words in order. Documents are dealt to shards by ranges of a signature of least hashes over their tokens, so documents
that share many tokens tend to meet, and a hot signature is split by row. Each shard is one task's: it builds an inverted index
of BM25 weights, whose document frequencies and mean length are of all documents, and packs its documents. The first
unused document seeds a window; the index returns the unused documents nearest to it, best first, and they fill the
window until one is cut at its end. What is left of that one seeds the next window.
"""

from __future__ import annotations

import os
import re
import zlib
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, nullable, written

MODEL = "word_bpe_49k.json"
#: The id behind each document.
END = 2
WINDOW = 4096
#: Tokens for each shard, and how many of a seed's terms, by weight, ask for neighbours.
SHARD, QUERY_TERMS = 2_000_000, 32
#: Words a worker keeps with their ids, twice over at most, of so many bytes each.
MOST_KNOWN, MOST_BYTES = 700_000, 64
#: Usual values of BM25's parameters.
K1, B = 1.2, 0.75
SIGNATURE = 2
#: ASCII letters in lower case, as the model has them anyway.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Kinds of bytes: a letter of ASCII, a stop, a blank, a byte beyond ASCII, and the rest.
KINDS = bytes(97 if 97 <= c <= 122 else 46 if c in b".," else 32 if c in b" \n" else 104 if c >= 128 else 120 for c in range(256))
#: A letter up to U+00FF, lower case but for accents, as UTF-8.
LETTER = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])"
#: A stop at the end of a stretch behind a character beyond ASCII that is no such letter.
BOUND_STOP = re.compile(rb"(?<=[\x80-\xff])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])[.,](?=[ \n])")
#: A word and the marks behind it, at most two pre-tokens of the model. An apostrophe may start one of its own.
WORD_AND_STOP = re.compile(rb"(" + LETTER + rb"+)([!-&(-/:-@\[-`{-~]*)")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def free_stops(text: bytes) -> bool:
    """Whether each full stop and comma at the end of a stretch follows a letter, so that it is a pre-token of its own."""
    kinds = text.translate(KINDS)
    return not (b"x. " in kinds or b".. " in kinds or b" . " in kinds or kinds.startswith(b". ") or (b"h. " in kinds and BOUND_STOP.search(text)))


#: Words that tell whether a model alone gives a word's ids.
PROBES = ("a", "i", "hello", "zzyzxq", "\u00fc", "na\u00efvet\u00e9", "stra\u00dfe", "\u00e0\u00ff\u00f8\u00e6\u00fe", "donaudampfschifffahrt")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level model."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """The ids of texts as the library gives them without special tokens added.

    The model's pre-tokens never cross white space, and its normal form treats each stretch between ASCII white space by itself,
    so a text's ids are those of its stretches in order. Distinct ones are encoded once; a stop behind a word is a pre-token of
    its own. A text that may hold a special token's string is the library's as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 1 << 16 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        self.end = np.array([END], self.kind).tobytes()
        # What a word's bytes stand for in the model, and whether the model alone gives a word's ids.
        self.letters = dict(zip(range(256), byte_letters(), strict=True))
        self.tokenize = self.library.model.tokenize
        self.direct = all(self.library.encode(w, add_special_tokens=False).ids == self.word_ids(w.encode()) for w in PROBES)
        self.known: dict[bytes, bytes] = {}
        #: What was known before the last time that memory was full; words met again come back from here.
        self.old: dict[bytes, bytes] = {}

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of a word of letters, which is one pre-token in its normal form: the library's model gives them by itself."""
        return [t.id for t in self.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters))]

    def encode_words(self, words: list[bytes]) -> None:
        """Learns words of letters, each of which is one pre-token and in lower case."""
        if not self.direct:
            return self.encode_stretches(words)
        known, code, tokenize, letters = self.known, self.code, self.tokenize, self.letters
        for w in words:
            # As word_ids(), without a call for each.
            ids = [t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(letters))]
            known[w] = pack(f"<{len(ids)}{code}", *ids)

    def encode_stretches(self, parts: list[bytes]) -> None:
        for p, got in zip(parts, self.library.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False), strict=True):
            ids = got.ids
            self.known[p] = pack(f"<{len(ids)}{self.code}", *ids)

    def learn(self, stretches: set[bytes]) -> None:
        known, words, others, joined = self.known, set(), [], []
        for w in stretches:
            if w.isalpha():
                words.add(w)
            elif m := WORD_AND_STOP.fullmatch(w):
                base = m[1] if m[1].isascii() else m[1].decode().lower().encode()
                if base not in known:
                    words.add(base)
                if base != w:
                    joined.append((w, base, m[2]))
            else:
                others.append(w)
        if words:
            self.encode_words(list(words))
        stops = {stop for _, _, stop in joined if stop and stop not in known}
        if others or stops:
            self.encode_stretches([*others, *stops])
        for w, base, stop in joined:
            known[w] = known[base] + known[stop] if stop else known[base]

    def __call__(self, text: bytes) -> bytes:
        """The ids and END, packed as little-endian numbers of `kind`."""
        if b"<|" in text:
            return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes() + self.end
        text = text.translate(LOWER)
        if free_stops(text):
            text = text.replace(b". ", b" . ").replace(b", ", b" , ").replace(b".\n", b" .\n").replace(b",\n", b" ,\n")
        stretches, known = text.split(), self.known
        ids = list(map(known.get, stretches))
        if at := [i for i, found in enumerate(ids) if found is None]:
            new = {stretches[i] for i in at}
            for w in new & self.old.keys() if self.old else ():
                known[w] = self.old[w]
                new.remove(w)
            if new:
                self.learn(new)
            for i in at:
                ids[i] = known[stretches[i]]
            for w in new:
                if len(w) > MOST_BYTES:
                    known.pop(w, None)
            if len(known) > MOST_KNOWN:
                self.known, self.old = {}, known
        return b"".join(ids) + self.end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task. The library's own threads would only crowd the tasks."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def least_hashes(size: int) -> np.ndarray:
    """Tables of fixed random orders of the ids, for signatures."""
    return np.stack([np.random.default_rng(k).permutation(size).astype(np.uint32) for k in range(SIGNATURE)])


def tokenised(docs: DataFrame, model: str) -> DataFrame:
    """Rows (rid, doc_id, ids, n, sig) of documents, and rows (term, df): in how many of a task's documents a term stands."""

    def work(batches):
        encode, rid = encoder(model), TaskContext.get().partitionId() << 40
        tables, df = least_hashes(encode.size), np.zeros(encode.size, np.int64)
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                rid += 1
                packed = encode(text or b"")
                ids = np.frombuffer(packed, encode.kind)
                own, _ = term_counts(ids[:-1])
                df[own] += 1
                # A text without terms has the least signature.
                sig = 0
                for x in (tables[:, own].min(1) + 1).tolist() if len(own) else []:
                    sig = sig << 31 | x
                rows.append((rid, packed, len(ids), sig))
            if rows:
                rids, ids, sizes, sigs = zip(*rows, strict=True)
                yield arrow_batch(batch.select(["doc_id"]), len(rows), types, rid=rids, ids=ids, n=sizes, sig=sigs, term=None, df=None)
        terms = np.flatnonzero(df)
        none = pa.RecordBatch.from_arrays([pa.nulls(len(terms), docs_type)], names=["doc_id"])
        yield arrow_batch(none, len(terms), types, rid=None, ids=None, n=None, sig=None, term=terms.astype(np.int32), df=df[terms])

    from pyspark.sql.pandas.types import to_arrow_type

    docs_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return docs.select("doc_id", "text").mapInArrow(work, nullable(docs, ["doc_id"], "rid long, ids binary, n int, sig long, term int, df long"))


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order and how often each stands."""
    ordered = np.sort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ids) else np.empty(0, np.int64)
    return ordered[starts], np.diff(np.append(starts, len(ids)))


class Index:
    """An inverted index of BM25 weights over a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owners, weights, self.queries = [], [], [], []
        for i, ids in enumerate(docs):
            t, tf = term_counts(ids[:-1])
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(ids) - 1) / mean))
            t, w = t[w > 0], w[w > 0]
            # The document's own heaviest terms are its query, ties by term.
            self.queries.append(t[np.argsort(-w, kind="stable")[:QUERY_TERMS]])
            terms.append(t)
            owners.append(np.full(len(t), i, np.int32))
            weights.append(w)
        flat = np.concatenate(terms) if terms else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owners, self.weights = np.concatenate(owners)[order] if terms else flat, np.concatenate(weights)[order] if terms else flat
        self.ends = np.cumsum(np.bincount(flat, minlength=len(idf)))
        self.size = len(docs)

    def scores(self, query: int) -> np.ndarray:
        """Each document's score for the query that a document makes."""
        spans = [(self.ends[t - 1] if t else 0, self.ends[t]) for t in self.queries[query].tolist()]
        if not spans:
            return np.zeros(self.size)
        return np.bincount(np.concatenate([self.owners[a:b] for a, b in spans]), np.concatenate([self.weights[a:b] for a, b in spans]), self.size)


def neighbours(index: Index, seed: int, free: np.ndarray):
    """(document, score) of the unused documents by score downwards, ties in order; then, in order, those that share no term of the query."""
    scores = index.scores(seed)
    while True:
        open_scores = np.where(free, scores, -1.0)
        best = int(open_scores.argmax())
        if open_scores[best] < 0:
            return
        yield best, float(scores[best])


def fill_windows(sizes: list[int], index: Index, window: int):
    """(sequence, document, start, length, offset, score) of pieces that fill windows one after another; the last one may stay short.

    score is that of the document for the window's seed, null for the seed itself.
    """
    free, first = np.ones(len(sizes), bool), 0
    held, done = None, 0
    sequence, at = 0, 0
    while True:
        if held is None:
            while first < len(sizes) and not free[first]:
                first += 1
            if first == len(sizes):
                return
            held, done = first, 0
            free[held] = False
        seed, score = held, None
        near = None
        while held is not None:
            length = min(sizes[held] - done, window - at)
            yield sequence, held, done, length, at, score
            done, at = done + length, at + length
            left = sizes[held] - done
            if at == window:
                sequence, at = sequence + 1, 0
                if not left:
                    held = None
                break
            near = near or neighbours(index, seed, free)
            held, score = next(near, (None, None))
            done = 0
            if held is not None:
                free[held] = False
        if held is None and at:
            return


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, the largest first."""
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def settled(pieces, window: int):
    """The pieces with a last, short sequence cut into sequences of powers of two, which need no padding."""
    tail, last = [], -1
    for piece in pieces:
        if piece[0] != last:
            tail, last = [], piece[0]
        tail.append(piece)
        if piece[4] + piece[3] == window:
            yield from tail
            tail = []
    rooms = powers(sum(p[3] for p in tail))
    at = 0
    for _, doc, start, length, _, score in tail:
        while length:
            n = min(length, rooms[0] - at)
            yield last, doc, start, n, at, score
            start, length, at = start + n, length - n, at + n
            if at == rooms[0]:
                rooms, at, last = rooms[1:], 0, last + 1


def pack_documents(docs: DataFrame, model: str | None = None, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, score): the pieces of all documents in sequences of at most `window` tokens.

    A document's tokens are the library's ids and END. Sequences are full but for each shard's last tokens, which make
    sequences of powers of two, so nothing is padded. A document that doesn't fit goes on in the next sequence. score is
    its BM25 for the document that seeds the sequence, null for that one; where no unused document shares a term of the
    seed's query the next ones in the shard's order follow, with score 0.

    A null or empty text is END alone. Very long texts fill sequences of their own and then seed one. Repeated rows, equal
    and null ids are documents of their own; an empty table gives an empty one, and further columns of docs play no part. A shard is
    about `shard` tokens, whatever the table's size.
    """
    model = model or default_model()
    rows = written(docs.transform(lambda d: tokenised(d, model)), "tokenised")
    texts = rows.where("rid is not null")
    count, total = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = rows.where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    # One number for each of the vocabulary's ids.
    df = np.zeros(encoder(model).size, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    # Terms that most documents hold weigh nothing.
    idf = np.maximum(0.0, np.log((count - df + 0.5) / (df + 0.5)))
    kind = encoder(model).kind
    shared = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, (total - count) / max(1, count))))

    def work(batches):
        idf, mean = shared.value
        ids, doc_ids = [], []
        for batch in batches:
            ids += [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            doc_ids.append(batch.column("doc_id"))
        if not ids:
            return
        doc_ids = pa.chunked_array(doc_ids).combine_chunks()
        here = TaskContext.get().partitionId() << 32
        pieces = list(settled(fill_windows([len(x) for x in ids], Index(ids, idf, mean), window), window))
        types = [pa.int64()] * 6 + [pa.float64()]
        for k in range(0, len(pieces), 50_000):
            seqs, owners, starts, lengths, offsets, scores = zip(*pieces[k : k + 50_000], strict=True)
            sums = [zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()) for d, a, n in zip(owners, starts, lengths, strict=True)]
            own = pa.RecordBatch.from_arrays([doc_ids.take(pa.array(owners, pa.int64()))], names=["doc_id"])
            yield arrow_batch(own, len(owners), types, start=starts, length=lengths, ids_crc32=sums, doc_tokens=[len(ids[d]) for d in owners], sequence_id=[here + s for s in seqs], offset=offsets, score=scores)

    dealt = texts.select("doc_id", "ids", "sig", "rid").repartitionByRange(max(1, round(total / shard)), "sig", "rid").sortWithinPartitions("sig", "rid")
    more = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, score double"
    return dealt.select("doc_id", "ids").mapInArrow(work, nullable(docs, ["doc_id"], more))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The vocabulary has no SQL form; tests hold the query against the library and the packing against brute force.
SQL = None
