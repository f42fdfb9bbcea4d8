"""Expressions over ``array<float>`` columns, as Spark SQL text.

Each function takes SQL text (usually a column name) and returns SQL text for
``F.expr``: one parse builds a whole nested expression, where the same built
from ``Column`` lambdas takes thousands of calls into the JVM. All of them keep
one row one row: no explode, no shuffle. Lambda variables carry the name of
their function, so fragments nest without clashing.
"""

from __future__ import annotations

from collections.abc import Sequence


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once per row.

    An expression named inside an element-wise lambda would otherwise be
    computed again for every element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def total(v: str) -> str:
    return f"aggregate({v}, 0D, (tot_a, tot_x) -> tot_a + tot_x)"


def abs_max(v: str) -> str:
    return f"array_max(transform({v}, am_x -> abs(am_x)))"


def mean(v: str) -> str:
    return f"({total(v)} / size({v}))"


def population_std(v: str) -> str:
    spread = f"sqrt(aggregate({v}, 0D, (ps_a, ps_x) -> ps_a + (ps_x - ps_mu) * (ps_x - ps_mu)) / size({v}))"
    return let("ps_mu", mean(v), spread)


def is_finite(v: str) -> str:
    """True when every element is a number; NaN, either infinity, a null element
    or a null array make it false."""
    top = f"array_max({v}) < double('infinity') and array_min({v}) > -double('infinity')"  # NaN is the largest of all
    return f"coalesce(size(array_compact({v})) = size({v}) and (size({v}) = 0 or ({top})), false)"


def same_shape(a: str, b: str) -> str:
    """True when both arrays exist, hold something and have one length."""
    return f"coalesce(size({a}) = size({b}) and size({a}) > 0, false)"


def last_token(states: str) -> str:
    """Vector of the last token of a token-by-dimension array."""
    return f"cast(element_at({states}, -1) as array<float>)"


def int4_round_trip(v: str) -> str:
    """Round to 4-bit integers and back; every step is rounded to float32.

    A zero vector has scale 0 and comes back unchanged.
    """
    level = "least(greatest(rint(cast(q4_x / q4_s as float)), -8D), 7D)"
    rounded = f"if(q4_s = 0, {v}, transform({v}, q4_x -> cast({level} * q4_s as float)))"
    return let("q4_s", f"cast({abs_max(v)} / 7D as float)", rounded)


def l2_distance(a: str, b: str) -> str:
    gaps = f"zip_with({a}, {b}, (l2_x, l2_y) -> cast(l2_x as double) - cast(l2_y as double))"
    return f"sqrt(aggregate({gaps}, 0D, (l2_a, l2_g) -> l2_a + l2_g * l2_g))"


def dot(a: str, b: str) -> str:
    return total(f"zip_with({a}, {b}, (dot_x, dot_y) -> dot_x * dot_y)")


def chunk_mean(v: str, width: int) -> str:
    """View a vector as tokens of ``width`` values and average over the tokens.

    The length must be a multiple of ``width``; other lengths fail the query.
    """
    added = (
        f"aggregate(sequence(0, cast(size({v}) div {width} as int) - 1), 0D, "
        f"(cm_a, cm_t) -> cm_a + element_at({v}, cm_i + cm_t * {width}))"
    )
    means = f"transform(sequence(1, {width}), cm_i -> {added} / (size({v}) div {width}))"
    return (
        f"if(size({v}) > 0 and size({v}) % {width} = 0, {means}, "
        f"cast(raise_error('vector length is no multiple of {width}') as array<double>))"
    )


def conv_relu_mean(v: str, kernel: Sequence[float], stride: int = 2) -> str:
    """One 1-D convolution with zero padding, ReLU, and the average over positions."""
    k = len(kernel)
    pad = k // 2
    weights = "array(" + ", ".join(f"{float(w)!r}D" for w in kernel) + ")"
    padded = f"concat(array_repeat(0D, {pad}), cast({v} as array<double>), array_repeat(0D, {pad}))"
    last = f"cast((size({v}) + {2 * pad - k}) div {stride} as int)"
    windowed = dot(f"slice(cv_p, cv_t * {stride} + 1, {k})", "cv_k")
    response = f"transform(sequence(0, {last}), cv_t -> greatest(0D, {windowed}))"
    return f"({total(let('cv_p', padded, let('cv_k', weights, response)))} / ({last} + 1))"
