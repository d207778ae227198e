"""A positional inverted index as a table: matching and ranking read postings, never the corpus.

A posting is (term, id, places): where a term stands in a row, and with what weight. A query meets the
rows that hold its rarest term; only the postings of such rows are shuffled, once, by row, and a query
is held against their other terms there. Cover density is computed from the matched postings by array
functions, once for all queries of the same terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Folders that postings are dealt to by term.
BUCKETS = 64
#: Terms of all queries together that may be broadcast.
TERMS = 100_000
#: Ids of rows with a query's rarest term that may be broadcast.
MET = 500_000
#: Parts of a folder, by id.
PARTS = 4
#: Rows of an Arrow batch: their lexemes are sorted together.
ROWS = 256
_LAST = "array<struct<i:int,pos:int,before:double>>"


def _entry() -> T.DataType:
    return T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("weight", T.DoubleType())]))


def _placed(every: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Rows' lexemes by (row, term, place): each posting's row and its code among ``terms``, where its places begin, and the places."""
    said = every.flatten()
    row = np.repeat(np.arange(len(every)), every.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    terms, pos, weight = said.field("lexeme").dictionary_encode(), said.field("pos").to_numpy(), said.field("weight").to_numpy()
    code = terms.indices.to_numpy()
    order = np.lexsort((pos, code, row))
    row, code = row[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.zeros(0, int)
    return row[first], code[first], terms.dictionary, np.append(first, len(row)), pos[order], weight[order]


def _places(ends: np.ndarray, pos: np.ndarray, weight: np.ndarray) -> pa.Array:
    entry = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(weight, pa.float64())], ["pos", "weight"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entry)


def index(rows: DataFrame, id_col: str = "chunk_id", lexemes: str = "lexemes", also: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, places) of rows with lexemes; columns named in ``also`` pass through.

    A row's lexemes are all in it, so they are grouped there, a batch of rows by one sort, and nothing
    is shuffled. Rows without lexemes have no postings, and no filter says so, as it would be pushed
    below joins and make the lexemes of rows that these drop. Ids are unique.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    keep = [id_col, *also]
    schema = T.StructType([T.StructField("term", T.StringType()), *(rows.schema[c] for c in keep), T.StructField("places", _entry())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, terms, ends, pos, weight = _placed(b.column(len(keep)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([terms.take(pa.array(code)), *(b.column(i).take(at) for i in range(len(keep))), _places(ends, pos, weight)], schema.names)

    return rows.select(*keep, lexemes).mapInArrow(run, schema)


def _bucket() -> Column:
    return F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")


def _part(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), id_col), F.lit(PARTS)).cast("int")


def dealt(postings: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Postings with the ``bucket`` of their term, to be written in folders by it, in order of term: a query's
    terms then prune folders and, within them, row groups. A term that all rows hold is dealt to PARTS tasks."""
    return postings.withColumn("bucket", _bucket()).repartition("bucket", _part(id_col)).sortWithinPartitions("bucket", "term")


def folders(rows: DataFrame, id_col: str = "chunk_id", lexemes: str = "lexemes", also: tuple[str, ...] = ()) -> DataFrame:
    """``dealt(index(rows))``, shuffled as packs.

    A posting by itself is mostly the padding of its row. So the postings of a batch that go to one part of a folder are
    a row of arrays on the way: its ids once, its terms once, and numbers for what belongs to which.
    """
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    keep = [id_col, *also]
    kinds = [rows.schema[c].dataType for c in keep]
    int_, string, double = T.IntegerType(), T.StringType(), T.DoubleType()
    lists = {**{f"_{i}": k for i, k in enumerate(kinds)}, "_held": int_, "_code": int_, "_terms": string, "_n": int_, "_pos": int_, "_weight": double}
    packed = T.StructType([T.StructField("bucket", int_), T.StructField("_part", int_), *(T.StructField(n, T.ArrayType(k)) for n, k in lists.items())])
    schema = T.StructType([T.StructField("term", string), *(rows.schema[c] for c in keep), T.StructField("places", _entry()), T.StructField("bucket", int_)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, code, terms, ends, pos, weight = _placed(b.column(len(keep) + 1))
            if not len(row):
                continue
            bucket = np.array([zlib.crc32(t.encode()) % BUCKETS for t in terms.to_pylist()])[code]
            part = b.column(len(keep)).to_numpy()[row]
            order = np.argsort((bucket * PARTS + part).astype(np.int16), kind="stable")  # rows and terms within a pack stay in order
            row, code, bucket, part, begin, n = (x[order] for x in (row, code, bucket, part, ends[:-1], np.diff(ends)))
            pack = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
            head = np.flatnonzero(pack)  # a pack's first posting
            lead = np.flatnonzero(pack | np.concatenate([[True], row[1:] != row[:-1]]))  # a pack's rows, by their first posting
            own, local = np.unique((np.cumsum(pack) - 1) * len(terms) + code, return_inverse=True)  # a pack's terms
            first = np.searchsorted(own, np.arange(len(head)) * len(terms))
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())  # its places

            def by(starts: np.ndarray, values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)

            rows_at, places_at = np.searchsorted(lead, head), np.concatenate([[0], np.cumsum(n)])[head]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[head], pa.int32()),
                    pa.array(part[head], pa.int32()),
                    *(by(rows_at, b.column(i).take(pa.array(row[lead]))) for i in range(len(keep))),
                    by(rows_at, pa.array(np.diff(np.append(lead, len(row))), pa.int32())),
                    by(head, pa.array(local - np.repeat(first, np.diff(np.append(head, len(row)))), pa.int32())),
                    by(first, terms.take(pa.array(own % len(terms)))),
                    by(head, pa.array(n, pa.int32())),
                    by(places_at, pa.array(pos[at], pa.int32())),
                    by(places_at, pa.array(weight[at], pa.float64())),
                ],
                packed.names,
            )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(packed.names, b.columns, strict=True))
            flat = {name: columns[name].flatten() for name in lists}
            size = columns["_code"].value_lengths().to_numpy()  # postings of a pack
            before = np.cumsum(columns["_terms"].value_lengths().to_numpy()) - columns["_terms"].value_lengths().to_numpy()
            at = pa.array(np.repeat(np.arange(len(flat["_held"])), flat["_held"].to_numpy()))
            term = flat["_terms"].take(pa.array(flat["_code"].to_numpy() + np.repeat(before, size)))
            places = _places(np.append(0, np.cumsum(flat["_n"].to_numpy())), flat["_pos"].to_numpy(), flat["_weight"].to_numpy())
            yield pa.RecordBatch.from_arrays([term, *(flat[f"_{i}"].take(at) for i in range(len(keep))), places, pa.array(np.repeat(columns["bucket"].to_numpy(), size), pa.int32())], schema.names)

    packs = rows.select(*keep, _part(id_col).alias("_part"), lexemes).mapInArrow(pack, packed)
    return packs.repartition("bucket", "_part").mapInArrow(unpack, schema).sortWithinPartitions("bucket", "term")


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, term, all): each term of a query once, beside all of them."""
    return queries.select("query_id", F.array_sort(F.array_distinct("terms")).alias("all")).select("query_id", F.explode("all").alias("term"), "all")


def small(rows: DataFrame, limit: int = TERMS) -> Callable[[DataFrame], DataFrame]:
    """Broadcast, if few terms are asked: postings are then filtered where they are read."""
    return F.broadcast if rows.limit(limit + 1).count() <= limit else lambda rows: rows


def of_terms_asked(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Only the postings that ``match`` reads for these queries, for an index that no others will use."""
    asked = _asked(queries)
    return postings.join(small(asked)(asked.select("term").distinct()), "term", "left_semi").select(*postings.columns)


def same_terms(queries: DataFrame) -> DataFrame:
    """(query_id, same_as, terms) of queries with terms: ``same_as`` is the smallest id of those that ask the same."""
    asked = queries.select("query_id", F.array_sort(F.array_distinct("terms")).alias("terms")).filter(F.size("terms") > 0)
    return asked.withColumn("same_as", F.min("query_id").over(Window.partitionBy("terms")))


def match(postings: DataFrame, queries: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, hits) of the rows that hold all of a query's ``terms``; hits are (term, places).

    A query without terms, or null ones, matches nothing. Only rows that hold some query's rarest term are
    gathered, so only their postings of terms asked are shuffled, once, however many queries ask them.
    """
    asked = _asked(queries)
    few = small(asked)
    held = postings.join(few(asked.select("term").distinct()), "term", "left_semi")
    frequency = held.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    rarity = F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), F.col("term"))
    rarest = asked.join(frequency, "term", "left").groupBy("query_id").agg(F.min_by("term", rarity).alias("term"), F.first("all").alias("all"), F.min(rarity)["_df"].alias("_df"))
    met = rarest.agg(F.sum("_df")).first()[0] or 0  # as many ids at most
    rarest = rarest.drop("_df")
    seeds = postings.join(few(rarest.select("term").distinct()), "term", "left_semi").select(F.col(id_col).alias("_seed")).distinct()
    seeds = F.broadcast(seeds) if met <= MET else seeds
    held = held.join(seeds, F.col(id_col).eqNullSafe(F.col("_seed")), "left_semi")
    rows = held.groupBy(id_col).agg(F.collect_list(F.struct("term", "places")).alias("_held")).select(id_col, F.col("_held.term").alias("_terms"), F.col("_held.places").alias("_places"))
    met = rows.select("*", F.explode(F.array_distinct("_terms")).alias("term")).join(few(rarest), "term")
    whole = met.filter(F.forall("all", lambda t: F.array_contains("_terms", t)))
    hits = F.transform("all", lambda t: F.struct(t.alias("term"), F.get("_places", (F.array_position("_terms", t) - 1).cast("int")).alias("places")))
    return whole.select("query_id", id_col, hits.alias("hits"))


def cover_density(hits: Column) -> Column:
    """Rank in [0, 1) of a row by the places of all of a query's terms in it.

    Places of all terms are walked in order. The last place of each term is kept; where all have
    one, the earliest of them opens a shortest stretch with all terms, unless the stretch before
    it opened there too. A stretch adds the harmonic mean of its weights over one plus its other words.
    """
    marked = F.transform(hits, lambda h, t: F.transform(h["places"], lambda p: F.struct(p["pos"].alias("pos"), h["term"].alias("term"), t.alias("t"), p["weight"].alias("weight"))))
    places = F.array_sort(F.flatten(marked))
    none = F.struct(F.lit(-1).alias("i"), F.lit(0).alias("pos"), F.lit(0.0).alias("before"))
    start = F.struct(F.transform(hits, lambda h: none).cast(_LAST).alias("last"), F.lit(0).alias("i"), F.lit(-1).alias("opened"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("total"))

    def step(acc: Column, p: Column) -> Column:
        here = F.struct(acc["i"].alias("i"), p["pos"].cast("int").alias("pos"), acc["sum"].alias("before"))
        last = F.transform(acc["last"], lambda x, t: F.when(t == p["t"], here).otherwise(x))
        summed = acc["sum"] + F.lit(1.0) / p["weight"]

        def total(left: Column) -> Column:
            n = acc["i"] - left["i"] + 1
            noise = F.greatest(F.lit(0), (p["pos"] - left["pos"]) - (n - 1))
            add = n / (summed - left["before"]) / (noise + 1)
            new = (left["i"] >= 0) & (left["i"] != acc["opened"])
            return F.struct(F.when(new, left["i"]).otherwise(acc["opened"]).alias("opened"), F.when(new, acc["total"] + add).otherwise(acc["total"]).alias("total"))

        def whole(last: Column) -> Column:
            t = total(F.array_min(last))
            return F.struct(last.cast(_LAST).alias("last"), (acc["i"] + 1).alias("i"), t["opened"].alias("opened"), summed.alias("sum"), t["total"].alias("total"))

        return F.get(F.transform(F.array(last), whole), F.lit(0))

    return F.aggregate(places, start, step, lambda acc: acc["total"] / (acc["total"] + 1))


def ranked_once(postings: DataFrame, same: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(same_as, id, keyword_score) of every row that holds all terms: one ranking for all queries of the same terms."""
    asked = same.filter("query_id = same_as").select("query_id", "terms")
    return match(postings, asked, id_col).select(F.col("query_id").alias("same_as"), id_col, cover_density(F.col("hits")).alias("keyword_score"))


def ranked(postings: DataFrame, queries: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, keyword_score) of every row that holds all of a query's terms."""
    same = same_terms(queries)
    return ranked_once(postings, same, id_col).join(same.select("query_id", "same_as"), "same_as").select("query_id", id_col, "keyword_score")


def best(rows: DataFrame, k: int, id_col: str = "chunk_id", query: str = "query_id") -> DataFrame:
    """The k rows of each query with the highest scores; ties go to the smaller id.

    Scores that differ from the 13th decimal on are ties: a sum of the same stretches ends in other
    digits in another order.
    """
    order = Window.partitionBy(query).orderBy(F.desc(F.round("keyword_score", 12)), id_col)
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
