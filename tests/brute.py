"""Other ways to the same results, for small fixtures."""

import contextlib
import io
import math

from pyspark.sql import functions as F

from kinlink.functions.signatures import MODULUS, hash_family, shingle_hash, shingles


def native_signature(name, length):
    """The signature as a column of Spark's own array functions, one minimum for each hash."""
    grams = F.transform(shingles(name), shingle_hash)

    def least(a, b):
        return F.array_min(F.transform(grams, lambda x: (x * a + b) % MODULUS))

    return F.when(F.size(grams) > 0, F.array(*[least(a, b) for a, b in hash_family(length)]))


def cosine(x, y):
    dot = sum(a * b for a, b in zip(x, y))
    return dot / math.sqrt(float(sum(a * a for a in x)) * float(sum(b * b for b in y)))


def best(queries, records):
    """{qid: (id, score)} for lists of (key, group, signature)."""
    found = {}
    for qid, group, sig in queries:
        scored = [
            (-cosine(sig, other), key)
            for key, place, other in records
            if place == group and other is not None and sig is not None
        ]
        if scored:
            score, key = min(scored)
            found[qid] = (key, -score)
    return found


def plan_text(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
