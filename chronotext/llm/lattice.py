"""SentencePiece encoding and decoding as a relational lattice over the distinct units of a corpus.

A text (a space is U+2581, and one stands in front) falls into units at every place that no piece reaches over, told
from the pairs of adjacent characters inside pieces; a unit's pieces are then those that it has in the whole text.
For each distinct unit, once: its substrings of bounded length are exploded, an equi-join with the piece table leaves
the edges of its lattice, edges are grouped by unit, and a higher-order aggregate folds them to the path.

The model at hand is byte-pair encoding, whose segmentation a Viterbi search over summed scores does not give. The fold
therefore takes the edges by score (then from the left) over a set of borders: an edge whose ends are borders with
exactly one border between them joins two symbols, and that border goes. What is left is the library's segmentation.
Characters without a piece become byte pieces. Borders of a unit of at most MOST_CHARS characters are one long, those of a
longer one an array of words of 32. Only units of more than LONG_CHARS characters, whose fold would take minutes, are
encoded by the library itself.

Defined results: null and empty texts have no pieces; U+2581 in a text cannot be told from a space, as in the library.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytescan, unitsums
from .shared import drop, fresh_name, hottest, stored, tidy

SPACE = "▁"
MOST_CHARS, LONG_CHARS = 60, 1 << 14
BLOCK_BYTES, PART_UNITS = 1 << 19, 20_000
#: Characters below this, and the space, have a table of pairs; others are looked up.
_NEAR = 0x250

_models: dict[str, object] = {}


def _library(path: str):
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


@dataclass
class Pieces:
    """The piece table of a model: a fixed, small dimension."""

    path: str
    piece: list[str]
    score: list[float]
    normal: list[bool]
    byte: dict[int, int]  # a byte's value to its piece's id
    unknown: int
    longest: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = _library(path)
        n = model.get_piece_size()
        ids = range(n)
        piece = [model.id_to_piece(i) for i in ids]
        normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        return cls(path, piece, [model.get_score(i) for i in ids], normal, {int(piece[i][3:5], 16): i for i in ids if model.is_byte(i)}, model.unk_id(), max(len(p) for p, ok in zip(piece, normal, strict=True) if ok))

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, order): order ranks the scores, best first."""
        order = np.argsort(np.argsort([-s for s in self.score], kind="stable"), kind="stable")
        rows = pd.DataFrame({"piece": self.piece, "id": np.arange(len(self.piece)), "order": order})[self.normal]
        return spark.createDataFrame(rows, "piece string, id int, order int")

    def hex(self) -> list[str]:
        """The bytes of every piece by id, in hexadecimal; control pieces have none."""
        back = {i: f"{b:02X}" for b, i in self.byte.items()}
        return [back.get(i) or (p.encode().hex().upper() if self.normal[i] else "") for i, p in enumerate(self.piece)]

    def inner_pairs(self) -> np.ndarray:
        """Pairs of adjacent characters inside pieces, as sorted numbers."""
        return np.array(sorted({(ord(a) << 21) | ord(b) for p, ok in zip(self.piece, self.normal, strict=True) if ok for a, b in zip(p, p[1:], strict=False)}), np.int64)


class Splitter:
    """Cuts whole texts in units; pickled with the pairs alone."""

    def __init__(self, pieces: Pieces):
        self.every = pieces.inner_pairs()
        self.table = None

    def __getstate__(self):
        return {"every": self.every, "table": None}

    @staticmethod
    def _near(chars: np.ndarray) -> np.ndarray:
        """Places in the table: the character itself, _NEAR for the space, _NEAR + 1 for all others."""
        out = np.minimum(chars, _NEAR + 1).astype(np.int32)
        out[chars == _NEAR] = _NEAR + 1
        out[chars == ord(SPACE)] = _NEAR
        return out

    def joined(self, chars: np.ndarray) -> np.ndarray:
        """Of each character but the first whether some piece has it right after the one before."""
        if self.table is None:
            self.table = np.zeros((_NEAR + 2) ** 2, bool)
            x, y = self._near(self.every >> 21), self._near(self.every & 0x1FFFFF)
            inside = (x <= _NEAR) & (y <= _NEAR)
            self.table[x[inside] * (_NEAR + 2) + y[inside]] = True
        near = self._near(chars)
        out = self.table[near[:-1] * (_NEAR + 2) + near[1:]]
        far = np.flatnonzero((near[:-1] > _NEAR) | (near[1:] > _NEAR))
        if len(far) and len(self.every):
            pair = (chars[far].astype(np.int64) << 21) | chars[far + 1]
            out[far] = self.every[np.minimum(np.searchsorted(self.every, pair), len(self.every) - 1)] == pair
        return out

    def __call__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        for row, offsets, _ in bytescan.blocks(column, BLOCK_BYTES):
            # a few texts at a time become Python strings, never the whole batch
            texts = column.slice(row, len(offsets) - 1).to_pylist()
            yield self._units(row, [f"{SPACE}{t.replace(' ', SPACE)}" if t else "" for t in texts])

    def _units(self, start: int, run: list[str]):
        whole = "".join(run)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.int32)
        base = np.zeros(len(run) + 1, np.int64)
        np.cumsum([len(t) for t in run], out=base[1:])
        begins = np.ones(len(chars), bool)
        if len(chars):
            np.logical_not(self.joined(chars), out=begins[1:])
            begins[base[:-1][base[:-1] < len(chars)]] = True
        begin = np.flatnonzero(begins)
        wide = 1 + (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF)
        at = np.zeros(len(chars) + 1, np.int64)
        np.cumsum(wide, out=at[1:])
        offsets = np.append(at[begin], at[-1])
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        return start, np.searchsorted(begin, base), units.cast(pa.string())


def _path(edges: F.Column, chars: F.Column) -> F.Column:
    """The pieces of the path as start and id in one long, sorted, from sorted edges packed as order, id, start and length.

    The state of the fold is the set of borders that are left (bit i: before character i). What it ends in is used
    inside the aggregate's last function, where it is one value: as a column it would be folded again for each edge.
    """
    one = F.lit(1).cast("long")
    left = lambda x, n: F.call_function("shiftleft", x, n)
    start_of = lambda e: F.shiftright(e, 8).bitwiseAND(F.lit(0xFF).cast("long")).cast("int")
    size_of = lambda e: e.bitwiseAND(F.lit(0xFF).cast("long")).cast("int")

    def step(borders: F.Column, edge: F.Column) -> F.Column:
        # the edge's ends, and all that lies between them, moved to its start
        inside = F.call_function("shiftright", borders, start_of(edge)).bitwiseAND(left(one, size_of(edge) + 1) - one)
        joins = (inside.bitwiseAND(one) == one) & (F.call_function("shiftright", inside, size_of(edge)) == one) & (F.bit_count(inside) == 3)
        gone = left(left(one, size_of(edge) - 1) - one, start_of(edge) + 1)
        return F.when((size_of(edge) > 1) & joins, borders.bitwiseAND(F.bitwise_not(gone))).otherwise(borders)

    def finish(borders: F.Column) -> F.Column:
        def kept(e: F.Column) -> F.Column:
            return F.call_function("shiftright", borders, start_of(e)).bitwiseAND(left(one, size_of(e) + 1) - one) == (left(one, size_of(e)) + one)

        placed = lambda e: F.shiftleft(e.bitwiseAND(F.lit(0xFF00).cast("long")), 24).bitwiseOR(F.shiftright(e, 16).bitwiseAND(F.lit(0xFFFFF).cast("long")))
        return F.sort_array(F.transform(F.filter(edges, kept), placed))

    return F.aggregate(edges, left(one, chars + 1) - one, step, finish)


def _long_path(edges: F.Column, chars: F.Column) -> F.Column:
    """_path() for units of any length: edges are sorted structs (order, start, size, id), the path structs (start, id)."""
    one, low = F.lit(1).cast("long"), F.lit(0xFFFFFFFF).cast("long")
    left = lambda x, n: F.call_function("shiftleft", x, n)
    word = lambda e: F.floor(e["start"] / 32).cast("int")
    # an edge of up to 32 characters lies in two words of 32 borders
    both = lambda borders, e: F.get(borders, word(e)).bitwiseOR(left(F.get(borders, word(e) + 1), F.lit(32)))
    inside = lambda borders, e: F.call_function("shiftrightunsigned", both(borders, e), e["start"] % 32).bitwiseAND(left(one, e["size"] + 1) - one)

    def step(borders: F.Column, e: F.Column) -> F.Column:
        here = inside(borders, e)
        joins = (e["size"] > 1) & (here.bitwiseAND(one) == one) & (F.call_function("shiftright", here, e["size"]) == one) & (F.bit_count(here) == 3)
        rest = both(borders, e).bitwiseAND(F.bitwise_not(left(left(one, e["size"] - 1) - one, e["start"] % 32 + 1)))
        gone = F.transform(borders, lambda x, i: F.when(i == word(e), rest.bitwiseAND(low)).when(i == word(e) + 1, F.shiftrightunsigned(rest, 32)).otherwise(x))
        return F.when(joins, gone).otherwise(borders)

    def finish(borders: F.Column) -> F.Column:
        kept = F.filter(edges, lambda e: inside(borders, e) == left(one, e["size"]) + one)
        return F.sort_array(F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id"))))

    return F.aggregate(edges, F.transform(F.sequence(F.lit(0), F.floor(chars / 32) + 1), lambda _: low), step, finish)


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, ids) of distinct units (unit, n), a table. Only the units are shuffled, never their edges."""
    spark = units.sparkSession
    many, longest = units.agg(F.count("*"), F.coalesce(F.max(F.char_length("unit")), F.lit(0))).first()
    # their edges are many times their size, so the parts are counted in units
    dealt = units.repartition(max(1, many // PART_UNITS), "unit").withColumn("chars", F.char_length("unit"))
    found = [_folded_units(dealt.where(F.col("chars") <= MOST_CHARS), pieces)]
    # an edge must lie in two words
    most = LONG_CHARS if pieces.longest <= 32 else MOST_CHARS
    if longest > MOST_CHARS:
        found.append(_folded_long_units(dealt.where((F.col("chars") > MOST_CHARS) & (F.col("chars") <= most)), pieces))
    if longest > most:
        path = pieces.path

        def by_library(batches):
            for batch in batches:
                # a unit may stand without the space that the library puts in front of a text
                out = [_raw_ids(_library(path), u) for u in batch.column(0).to_pylist()]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["unit", "n", "ids"])

        found.append(dealt.where(F.col("chars") > most).select("unit", "n").mapInArrow(tidy(by_library), "unit string, n long, ids array<int>"))
    return reduce(DataFrame.unionAll, found)


def _edges(units: DataFrame, pieces: Pieces) -> DataFrame:
    """The edges of every unit's lattice: substrings of bounded length that are pieces, and single characters (order and id null if no piece)."""
    table = F.broadcast(pieces.table(units.sparkSession))  # as many rows as the model has pieces
    cut = units.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("chars") - 1))).withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.col("chars") - F.col("start")))))
    return cut.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size"))).join(table, "piece", "left").where(F.col("id").isNotNull() | (F.col("size") == 1))


def _bytes_of(char: F.Column, pieces: Pieces) -> F.Column:
    """The ids of a character that is no piece: those of its bytes, or the unknown piece."""
    if not pieces.byte:
        return F.array(F.lit(pieces.unknown))
    by_byte = F.array(*[F.lit(pieces.byte.get(b, pieces.unknown)) for b in range(256)])
    spell = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(1), F.length(spell) - 1, F.lit(2)), lambda k: F.element_at(by_byte, F.conv(F.substring(spell, k, F.lit(2)), 16, 10).cast("int") + 1))


def _folded_long_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    named = units.withColumn("key", F.sha2("unit", 256))  # edges carry this and not the unit
    entry = F.struct(F.coalesce("order", F.lit((1 << 20) - 1)).cast("int").alias("order"), F.col("start"), F.col("size"), F.coalesce("id", F.lit(pieces.unknown)).alias("id"))
    grouped = _edges(named, pieces).groupBy("key", "chars").agg(F.sort_array(F.collect_list(entry)).alias("edges"))
    placed = grouped.select("key", _long_path(F.col("edges"), F.col("chars")).alias("path")).join(named.select("key", "unit", "n"), "key")
    spelled = lambda p: F.when(p["id"] == pieces.unknown, _bytes_of(F.substring(F.col("unit"), p["start"] + 1, F.lit(1)), pieces)).otherwise(F.array(p["id"]))
    return placed.select("unit", "n", F.flatten(F.transform("path", spelled)).alias("ids"))


def _folded_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    edges = _edges(units, pieces)
    # order, id, start and length in one long; a character without a piece has the id of the unknown piece and comes last
    packed = F.shiftleft(F.coalesce("order", F.lit((1 << 20) - 1)).cast("long"), 36).bitwiseOR(F.shiftleft(F.coalesce("id", F.lit(pieces.unknown)).cast("long"), 16)).bitwiseOR((F.col("start") * 256 + F.col("size")).cast("long"))
    grouped = edges.groupBy("unit", "n", "chars").agg(F.sort_array(F.collect_list(packed)).alias("edges"))
    placed = grouped.withColumn("path", _path(F.col("edges"), F.col("chars")))
    ids = F.transform("path", lambda p: p.bitwiseAND(F.lit(0xFFFFF).cast("long")).cast("int"))
    none = F.lit(pieces.unknown)

    def spelled(p):
        i = p.bitwiseAND(F.lit(0xFFFFF).cast("long")).cast("int")
        return F.when(i == none, _bytes_of(F.substring(F.col("unit"), F.shiftright(p, 32).cast("int") + 1, F.lit(1)), pieces)).otherwise(F.array(i))

    return placed.select("unit", "n", F.when(F.array_contains(ids, pieces.unknown), F.flatten(F.transform("path", spelled))).otherwise(ids).alias("ids"))


def _raw_ids(model, unit: str) -> list[int]:
    """The ids of a unit that need not begin with a space: behind a line end, which no piece reaches over."""
    text = unit.replace(SPACE, " ")
    if text.startswith(" "):
        return model.encode(text[1:])
    lead = model.encode("\n")
    return model.encode("\n" + text)[len(lead) :]


def decoded(ids: F.Column, pieces: Pieces) -> F.Column:
    """The text of a column of ids, spaces still as U+2581: each id's bytes by its place in a constant array."""
    table = F.split(F.lit(",".join(pieces.hex())), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")), "UTF-8")


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows` with the text that their ids stand for."""
    plain = F.translate(decoded(F.col(ids), pieces), SPACE, " ")
    return rows.withColumn(text, F.when(F.size(ids) == 0, F.lit("")).otherwise(F.regexp_replace(plain, "^ ", "")))


class Decoder:
    """decode() of lists of ids in Arrow: the bytes of all ids side by side, cut where a row's ids end."""

    def __init__(self, pieces: Pieces):
        self.bytes = pa.array([bytes.fromhex(h) for h in pieces.hex()], pa.large_binary())

    def __call__(self, lists: pa.ListArray) -> pa.Array:
        spelled = self.bytes.take(lists.flatten())
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1, 8 * spelled.offset)
        begin = lists.offsets.to_numpy()
        places = pa.py_buffer(np.ascontiguousarray(ends[begin - begin[0]]))
        plain = pc.replace_substring(pa.LargeStringArray.from_buffers(len(lists), places, spelled.buffers()[2]), SPACE, " ")
        return pc.if_else(pc.starts_with(plain, " "), pc.utf8_slice_codeunits(plain, 1), plain).cast(pa.string())


def encoded_vocabulary(docs: DataFrame, pieces: Pieces, text: str = "text", measured: bool = True) -> DataFrame:
    """(unit, n, ids) and, where measured, (n_pieces, ids_sum, n_changed) of every distinct unit of the texts, as a table."""
    words = stored(unitsums.vocabulary(docs, text, Splitter(pieces)), "vocabulary")
    known = encode_units(words, pieces)
    if not measured:
        out = stored(known, "units")
        drop(words)
        return out
    out = stored(known.select("unit", "n", "ids", F.size("ids").cast("long").alias("n_pieces"), F.pmod(F.xxhash64("ids"), F.lit(1 << 31)).alias("ids_sum"), F.when(decoded(F.col("ids"), pieces) == F.col("unit"), 0).otherwise(1).cast("long").alias("n_changed")), "units")
    drop(words)
    return out


def totals(docs: DataFrame, pieces: Pieces, key: str = "doc_id", text: str = "text", hot: int = unitsums.HOT_UNITS) -> DataFrame:
    """One row per row of `docs`: key, n_bytes, n_pieces, ids_sum (over its units, of a hash of their ids), n_changed (units that do not decode to themselves)."""
    return unitsums.weighted_sums(docs, encoded_vocabulary(docs, pieces, text), ["n_pieces", "ids_sum", "n_changed"], Splitter(pieces), key, text, hot)


def _cold(coded: pa.DictionaryArray, begin: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of rows: (row, code, ordinal) of the distinct units of each row that are not among `words`, in order of their first place."""
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    cold = pc.is_null(pc.index_in(coded.dictionary, value_set=words)).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    pick = np.flatnonzero(cold[codes])
    pairs, first = np.unique(of[pick] * len(cold) + codes[pick], return_index=True)
    order = np.argsort(first, kind="stable")  # rows stand in order, so first places do too
    row, code = pairs[order] // len(cold), pairs[order] % len(cold)
    return row, code, np.arange(len(row)) - np.searchsorted(row, row)


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids", hot: int = unitsums.HOT_UNITS, back: str | None = None) -> DataFrame:
    """`docs` with the ids of every whole text and, in a column `back` if that is given, the text that those ids stand for.

    The ids of the most frequent units, a fixed number at most, are broadcast. For its other units, each once, a row asks
    the vocabulary, and gets their ids back as one list in the order of its units, with the number of each. A row is told by two hashes of all its
    columns, which a lost executor's work gives again; equal rows share their answers. Columns named `ids` and `back` are
    replaced; columns of any other names go through as they are. `back` is what decode() makes of the ids, told from them
    alone, in the pass that puts them together.
    """
    docs = docs.drop(ids, *([] if back is None else [back]))
    known = encoded_vocabulary(docs, pieces, text, measured=False)
    least = hottest(known, hot)
    table = known.where(F.col("n") >= least).select("unit", "ids").toArrow()
    words, first = table["unit"].combine_chunks().cast(pa.string()), table["ids"].combine_chunks()
    shared = docs.sparkSession.sparkContext.broadcast((words, first))
    split = Splitter(pieces)
    keys = [fresh_name(docs.columns, "_key"), fresh_name(docs.columns, "_key2")]
    own_name, sizes_name = fresh_name(docs.columns, "_own"), fresh_name(docs.columns, "_sizes")
    told = [f.name for f in docs.schema if "map" not in f.dataType.simpleString()]
    keyed = docs.withColumns({keys[0]: F.xxhash64(*told), keys[1]: F.xxhash64(F.lit(1), *told)})

    def rare(batches):
        words, _ = shared.value
        for batch in batches:
            for row, begin, units in unitsums.together(split(batch.column(2))):
                coded = units.dictionary_encode()
                at, code, ordinal = _cold(coded, begin, words)
                at = pa.array(at + row)
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(ordinal.astype(np.int32)), coded.dictionary.take(pa.array(code))], ["key", "key2", "at", "unit"])

    asked = keyed.select(*keys, text).mapInArrow(tidy(rare), "key long, key2 long, at int, unit string").repartition("unit").dropDuplicates(["unit", "key", "key2", "at"])
    found = asked.join(known.where(F.col("n") < least).select("unit", "ids"), "unit").groupBy("key", "key2").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("own"))
    answers = stored(found.select(F.col("key").alias(keys[0]), F.col("key2").alias(keys[1]), F.flatten(F.transform("own", lambda x: x["ids"])).alias(own_name), F.transform("own", lambda x: F.size(x["ids"])).alias(sizes_name)), "answers")
    drop(known)
    at_text, n_columns, names = docs.columns.index(text), len(docs.columns), [*docs.columns, ids, *([] if back is None else [back])]
    decoder = None if back is None else Decoder(pieces)

    def assemble(batches):
        words, lists = shared.value
        for batch in batches:
            out: list = []
            texts: list = []
            for row, begin, units in unitsums.together(split(batch.column(at_text))):
                coded = units.dictionary_encode()
                answered = batch.column(n_columns).slice(row, len(begin) - 1)
                counts = batch.column(n_columns + 1).slice(row, len(begin) - 1).flatten().to_numpy(zero_copy_only=False)
                given = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), answered.flatten())
                at, code, ordinal = _cold(coded, begin, words)
                if len(given) != len(at):
                    raise ValueError("a row has not got all the ids that it asked for")
                # of each of the run's units one place among the answers, or among the broadcast ones
                place = np.full(len(coded.dictionary), -1, np.int64)
                place[code] = np.arange(len(at))
                asked_at = pa.array(place, mask=place < 0)
                own = given.take(asked_at) if len(given) else pa.nulls(len(place), pa.list_(pa.int32()))
                hot_at = pc.index_in(coded.dictionary, value_set=words)
                merged = pc.if_else(pc.is_null(hot_at), own.cast(lists.type), lists.take(hot_at))
                # the ids of every unit in order, as one list for each row
                chosen = merged.take(coded.indices)
                sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(chosen), 0).to_numpy(zero_copy_only=False))])
                out.append(pa.ListArray.from_arrays(pa.array(sizes[begin].astype(np.int32)), chosen.flatten().cast(pa.int32())))
                if decoder is not None:
                    texts.append(decoder(out[-1]))
            results = [pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))]
            if decoder is not None:
                results.append(pa.concat_arrays(texts) if texts else pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *results], names)

    # the rest of a row goes through with its text, so texts are shuffled once
    joined = keyed.join(answers, keys, "left").select(*docs.columns, own_name, sizes_name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(tidy(assemble), f"{fields}, `{ids}` array<int>" + ("" if back is None else f", `{back}` string"))
