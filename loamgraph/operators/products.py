"""Scores of many bags of terms against many others without a row for each term they share.

The postings of one side lie in the shared folder, a key in one file; every task reads them from there and adds them up for the rows of the other
side that it is given, so no pair is shuffled. Postings beyond ``BLOCK`` are read in blocks, one at a time.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from loamgraph.session import materialize, ship, shuffle_partitions

BLOCK = 16_000_000  # postings that a worker holds at once, 16 bytes each
CELLS = 4_000_000  # scores that a worker holds at once, at least those of one row


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows spread over tasks by how long they take and not by their size, which is small."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), 4 * df.sparkSession.sparkContext.defaultParallelism), *columns)


def write_postings(weights: DataFrame, label: str) -> tuple[str, ...]:
    """Write key, term, w, all rows of a key to one file; returns the files."""
    kept = weights.where("key is not null and term is not null").repartition(shuffle_partitions(weights.sparkSession), "key")
    return tuple(sorted(materialize(kept, label).inputFiles()))


def round6(x):
    """Positive doubles rounded half up to six decimals, as ``round`` of Spark has them."""
    import numpy as np

    low = np.floor(x * 1e6)
    part = x * 1e6 - low
    out = (low + (part >= 0.5)) / 1e6
    for k in np.flatnonzero((np.abs(part - 0.5) < 1e-4) | (x > 1e9)):  # decided by the decimal digits
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


class Block:
    """Postings of some keys: those of the k-th term are ``at[starts[k]:starts[k + 1]]``, places in ``keys``, and ``w`` beside them."""

    def __init__(self, files: tuple[str, ...]):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        t = pa.concat_tables([pq.read_table(path, filesystem=fs, columns=["key", "term", "w"]) for fs, path in map(_found, files)])
        self.keys = pc.unique(t["key"])
        self.keys = self.keys.take(pc.sort_indices(self.keys))  # by key, so equal scores stand in the order of their keys
        self.terms = pc.unique(t["term"])
        place = pc.index_in(t["key"], value_set=self.keys).to_numpy().astype(np.int64)
        code = pc.index_in(t["term"], value_set=self.terms).to_numpy().astype(np.int64)
        order = np.lexsort((place, code))
        self.code = {t: k for k, t in enumerate(self.terms.to_pylist())}
        self.at, self.w = place[order], t["w"].to_numpy()[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.terms)))])

    def scores(self, codes, by=None):
        """The sum of the weights of each key over some terms, each times ``by``; 0 where it has none of them."""
        import numpy as np

        if not len(codes):
            return np.zeros(len(self.keys))
        ends = [(self.starts[c], self.starts[c + 1]) for c in codes]
        w = np.concatenate([self.w[a:b] for a, b in ends])
        if by is not None:
            w *= np.repeat(by, [b - a for a, b in ends])
        return np.bincount(np.concatenate([self.at[a:b] for a, b in ends]), w, len(self.keys))


def _found(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@lru_cache(1)
def _blocks(files: tuple[str, ...], limit: int) -> list[tuple[str, ...]]:
    """The files in groups of at most ``limit`` postings, or of one file."""
    import pyarrow.parquet as pq

    out, room = [], 0
    for f in files:
        fs, path = _found(f)
        n = pq.read_metadata(path, filesystem=fs).num_rows
        if n and n <= room:
            out[-1], room = (*out[-1], f), room - n
        elif n:
            out.append((f,))
            room = limit - n
    return out


@lru_cache(1)
def block(files: tuple[str, ...]) -> Block:
    """Kept by the worker from task to task."""
    return Block(files)


def outstanding(files: DataFrame, posts: tuple[str, ...], record_type, *, z_min: float, per_file: int, limit: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """file, record, score, z: the best records of a file by z to six decimals and then by record, of those with at least ``z_min``.

    ``files`` has file, terms and known, records that count in the mean and deviation but are not given. The score of a record is the
    sum of its weights over the terms; those that have none of them don't count.
    """
    ship(files.sparkSession)

    def best(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        groups = _blocks(posts, limit)
        if not groups:
            return
        keys = pa.concat_arrays([block(g).keys for g in groups])
        schema = pa.schema([("file", pa.string()), ("record", keys.type), ("score", pa.float64()), ("z", pa.float64())])
        step = max(1, cells // len(keys))
        for rows in (b.slice(at, step).to_pylist() for b in batches for at in range(0, b.num_rows, step)):
            parts = [[p.scores([p.code[t] for t in r["terms"] if t in p.code]) for r in rows] for p in map(block, groups)]
            out = []
            for r, *part in zip(rows, *parts):
                s = np.concatenate(part)
                met = s[s > 0]
                if len(met) < 2 or np.sqrt(len(met) - 1) < z_min:
                    continue
                mean, sd = met.mean(), met.std()
                sd = sd if sd > 0 else 1.0
                hit = np.flatnonzero((s > 0) & (s >= mean + (z_min - 1e-5) * sd))
                found = pa.table({"record": keys.take(pa.array(hit)), "score": s[hit], "z": round6((s[hit] - mean) / sd)})
                found = found.filter(pc.field("z") >= z_min)
                if r["known"]:
                    found = found.filter(pc.invert(pc.is_in(found["record"], value_set=pa.array(r["known"], keys.type))))
                found = found.take(pc.sort_indices(found, sort_keys=[("z", "descending"), ("record", "ascending")])[:per_file])
                out += [{"file": r["file"], **x} for x in found.to_pylist()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    schema = StructType([StructField("file", StringType()), StructField("record", record_type), StructField("score", DoubleType()), StructField("z", DoubleType())])
    return spread(files.select("file", "terms", "known"), "file").mapInArrow(best, schema)


def all_scores(bags: DataFrame, posts: tuple[str, ...], key_type, *, field_weights: dict[str, float], mean_length: dict[str, float], k1: float, b: float, limit: int = BLOCK, cells: int = CELLS // 4) -> DataFrame:
    """key, id, score to six decimals: every bag against every key of the postings that it shares a term with, by BM25F.

    ``bags`` has id and bag, an array of field, term, tf. Weighted frequencies of a term add up over the fields before they saturate.
    """
    ship(bags.sparkSession)
    fields = [f for f in field_weights if f in mean_length]

    def score(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        weight, mean = np.array([field_weights[f] for f in fields]), np.array([mean_length[f] for f in fields])
        groups = _blocks(posts, limit)
        for batch in batches if groups else ():
            bag = batch.column("bag")
            flat = bag.flatten()
            row = bag.value_parent_indices().to_numpy().astype(np.int64)
            term, tf = flat.field("term"), flat.field("tf").to_numpy()
            field = pc.fill_null(pc.index_in(flat.field("field"), value_set=pa.array(fields, pa.string())), -1).to_numpy().astype(np.int64)
            place = row * len(fields) + field
            length = np.bincount(place[field >= 0], tf[field >= 0], batch.num_rows * len(fields))
            for g in groups:
                p = block(g)
                code = pc.fill_null(pc.index_in(term, value_set=p.terms), -1).to_numpy().astype(np.int64)
                here = (code >= 0) & (field >= 0)
                f = field[here]
                norm = weight[f] * tf[here] / (1 - b + b * length[place[here]] / mean[f])
                pairs, inverse = np.unique(row[here] * len(p.terms) + code[here], return_inverse=True)
                x = np.bincount(inverse, norm, len(pairs))
                x, at, code = x / (k1 + x), pairs // len(p.terms), pairs % len(p.terms)
                ends = np.searchsorted(at, np.arange(batch.num_rows + 1))
                ids, found, sums, held = [], [], [], 0
                for k in range(batch.num_rows):
                    if ends[k] < ends[k + 1]:
                        s = p.scores(code[ends[k] : ends[k + 1]], x[ends[k] : ends[k + 1]])
                        hit = np.flatnonzero(s)
                        ids.append(k)
                        found.append(hit)
                        sums.append(s[hit])
                        held += len(hit)
                    if ids and (held >= cells or k == batch.num_rows - 1):
                        offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in found])]), pa.int32())
                        lists = [pa.ListArray.from_arrays(offsets, v) for v in (p.keys.take(pa.array(np.concatenate(found))), pa.array(round6(np.concatenate(sums))))]
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids)), *lists], ["id", "keys", "scores"])
                        ids, found, sums, held = [], [], [], 0

    schema = StructType([StructField("id", bags.schema["id"].dataType), StructField("keys", ArrayType(key_type)), StructField("scores", ArrayType(DoubleType()))])
    rows = spread(bags.select("id", "bag"), "id").mapInArrow(score, schema)
    return rows.select("id", "keys", F.posexplode("scores").alias("k", "score")).select(F.get("keys", "k").alias("key"), "id", "score")
