"""Similarity of texts that follow one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that meet in one group, as a power of two.
RUN_BITS = 8


def _jaccards(k: int):
    """Kernel of following over the texts of one run of ids."""

    def run(table):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        lists = pa.concat_arrays([pc.split_pattern(c.cast(pa.large_string()), " ") for c in table["words"].chunks])
        words, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        codes, doc = words.dictionary_encode().indices.to_numpy()[filled].astype(np.int64), doc[filled]
        # k numbers of words in one of 63 bits: numbers that grow too large are dealt anew, so equal ones are equal runs
        bits = max(int(codes.max(initial=0)).bit_length(), 1)
        n, runs, used = max(len(codes) - k + 1, 0), codes[: max(len(codes) - k + 1, 0)], bits
        for i in range(1, k):
            if used + bits > 63:
                runs, distinct = pd.factorize(runs)
                runs, used = runs.astype(np.int64), max(len(distinct).bit_length(), 1)
            runs, used = runs << bits | codes[i : i + n], used + bits
        whole = doc[:n] == doc[k - 1 : k - 1 + n]
        runs, doc = runs[whole], doc[:n][whole]
        ends = np.searchsorted(doc, np.arange(len(table) + 1))
        sets, places = {}, {}
        for i, x in enumerate(table["id"].to_pylist()):
            if ends[i] < ends[i + 1]:
                sets[i] = np.unique(runs[ends[i] : ends[i + 1]])
                places.setdefault(x, []).append(i)
        ids, found = [], []
        for x, own in places.items():
            for j in places.get(x + 1, ()):
                for i in own:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    ids.append(x)
                    found.append(both / (len(sets[i]) + len(sets[j]) - both))
        return pa.table({"id": pa.array(ids, pa.int64()), "similarity": pa.array(found, pa.float64())})

    return run


def following(texts: DataFrame, k: int = 5) -> DataFrame:
    """(id, similarity): the Jaccard similarity of the sets of k-word runs of each text and the one with the next id.

    texts: (id, text).  Words are those of text.tokens; texts with fewer than
    k have no set.  Runs of ids come together, the first of the next run with
    them, so each text moves once, as text, and its set is made where it is used.
    """
    words = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ").alias("words")
    near = F.array_distinct(F.array(F.shiftright("id", RUN_BITS), F.shiftright(F.col("id") - 1, RUN_BITS)))
    rows = texts.where("id IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast("long").alias("id"), "text").select("id", words, F.explode(near).alias("run"))
    return rows.groupBy("run").applyInArrow(_jaccards(k), "id long, similarity double")
