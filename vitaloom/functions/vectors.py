"""Vector expressions on array columns."""

from pyspark.sql import functions as F

from vitaloom.functions.text import bind

SIMILARITY_SCALE = 1e12


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, p: s + p)


def norm(a):
    return F.sqrt(dot(a, a))


def scaled(a, norm_a):
    """The vector of length ``norm_a`` scaled to length one."""
    return bind(F.nullif(norm_a, F.lit(0.0)), lambda n: F.transform(a, lambda x: F.coalesce(x.cast("double") / n, F.lit(0.0))))


def unit(a):
    """The vector scaled to length one; do this once per row, before any join."""
    return bind(norm(a), lambda length: scaled(a, length))


def cosine(a, b):
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity(unit_a, unit_b):
    """Cosine of two unit vectors to 12 decimals, so that the order of the additions does not show."""
    return F.rint(dot(unit_a, unit_b) * F.lit(SIMILARITY_SCALE)) / F.lit(SIMILARITY_SCALE)


def similarity_scaled(a, norm_a, unit_b):
    """:func:`similarity` of a vector that still has its length ``norm_a``: scaled as :func:`unit` does, number by number."""
    n = F.nullif(norm_a, F.lit(0.0))
    products = F.zip_with(a, unit_b, lambda x, y: F.coalesce(x.cast("double") / n, F.lit(0.0)) * y)
    total = F.when(F.size(a) == F.size(unit_b), F.aggregate(products, F.lit(0.0), lambda s, p: s + p))
    return F.rint(total * F.lit(SIMILARITY_SCALE)) / F.lit(SIMILARITY_SCALE)


def nonzero(unit_vectors):
    """The vectors of an array as lists of their places and numbers that are not zero."""
    return F.transform(unit_vectors, lambda v: F.filter(
        F.transform(v, lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda e: e["x"] != 0))


def similarities(vector, unit_vectors, sparse=False):
    """Cosine of a vector with each vector of an array of unit vectors; ``sparse`` ones are in the form of :func:`nonzero`."""
    def one(u, o):
        few = F.aggregate(o, F.lit(0.0), lambda s, e: s + F.get(u, e["at"]) * e["x"])
        return F.when(u.isNotNull(), few) if sparse else dot(u, o)

    return bind(unit(vector), lambda u: F.transform(unit_vectors, lambda o: one(u, o)))


def topk_mean_similarity(sims, k):
    best = F.slice(F.sort_array(sims, asc=False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(best), F.lit(0))


def semantic_to_ideal(vector, ideals, k=5, weight=22.0, most=20.0, sparse=False):
    """Points for being close to the ideal vectors, an array of unit vectors; null without a vector or without ideals."""
    points = topk_mean_similarity(similarities(vector, ideals, sparse), k) * F.lit(weight)
    return points if most is None else F.when(points.isNotNull(), F.least(F.lit(most), points))
