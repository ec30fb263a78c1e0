"""Balanced brackets as column functions: folds over the tokens of a name, without Python.

A name is cut into tokens: brackets, `` as `` and the text between. One fold with a stack pairs the brackets; brackets that
never close are text. A second fold walks tokens or pairs and builds what is left of the name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_PAIRS = "array<struct<at:int,end:int,casts:boolean,parent:int>>"
_OPEN = "array<struct<at:int,casts:boolean>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _tokens(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("(?s)[<>]| as |[^<> ]+| "), F.lit(0))


def _places(tokens: Column) -> Column:
    return F.transform(tokens, lambda _, i: i)


def _pairs(tokens: Column) -> Column:
    """Closed pairs in the order of their opening tokens: places, whether `` as `` stands directly inside, the pair around (-1: none)."""

    def step(acc: Column, i: Column) -> Column:
        token, stack, found = F.get(tokens, i), acc["stack"], acc["found"]
        top, rest = F.get(stack, F.size(stack) - 1), F.slice(stack, 1, F.size(stack) - 1)
        pair = F.struct(top["at"].alias("at"), i.alias("end"), top["casts"].alias("casts"), F.coalesce(F.get(rest, F.size(rest) - 1)["at"], F.lit(-1)).alias("parent"))
        state = lambda s, f: F.struct(s.cast(_OPEN).alias("stack"), f.cast(_PAIRS).alias("found"))
        inside = F.size(stack) > 0
        return (
            F.when(token == "<", state(F.concat(stack, F.array(F.struct(i.alias("at"), F.lit(False).alias("casts")))), found))
            .when((token == ">") & inside, state(rest, F.concat(found, F.array(pair))))
            .when((token == " as ") & inside, state(F.concat(rest, F.array(F.struct(top["at"].alias("at"), F.lit(True).alias("casts")))), found))
            .otherwise(state(stack, found))
        )

    zero = F.struct(F.array().cast(_OPEN).alias("stack"), F.array().cast(_PAIRS).alias("found"))
    return F.array_sort(F.aggregate(_places(tokens), zero, step, lambda acc: acc["found"]))


def _joined(tokens: Column, first: Column, end: Column) -> Column:
    """Text of the tokens from ``first`` up to ``end``, excluded."""
    return F.array_join(F.slice(tokens, first + 1, F.greatest(end - first, F.lit(0))), "")


def _scanned(name: Column, opens: Callable, closed: Callable, unclosed: Callable) -> Column:
    """A walk from left to right that replaces outermost pairs.

    ``opens(tokens, i, done)``: does a bracket that the walk meets count; ``closed(out, inner)``: what is left where it
    closes; ``unclosed(out, rest)``: what is left of the whole name where it doesn't.
    """

    def walk(tokens: Column) -> Column:
        def with_ends(ends: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                token, out, done = F.get(tokens, i), acc["out"], acc["done"]
                end = F.try_element_at(ends, i)
                state = lambda o, d: F.struct(o.alias("out"), d.cast("int").alias("done"))
                meets = (token == "<") & opens(tokens, i, done)
                return (
                    F.when(i <= done, acc).when(meets & end.isNotNull(), state(closed(out, _joined(tokens, i + 1, end)), end))
                    .when(meets, state(unclosed(out, _joined(tokens, i, F.size(tokens))), F.size(tokens))).otherwise(state(F.concat(out, token), done))
                )

            return F.aggregate(_places(tokens), F.struct(F.lit("").alias("out"), F.lit(-1).alias("done")), step, lambda acc: acc["out"])

        return _let(F.map_from_entries(F.transform(_pairs(tokens), lambda p: F.struct(p["at"], p["end"]))), with_ends)

    return _let(_tokens(name), walk)


def _after_colons(tokens: Column, i: Column, done: Column) -> Column:
    return (i - 1 > done) & F.coalesce(F.endswith(F.get(tokens, i - 1), F.lit("::")), F.lit(False))


def _cut(out: Column) -> Column:
    """Without the ``::`` at the end."""
    return F.substr(out, F.lit(1), F.length(out) - 2)


def drop_turbofish(name: Column) -> Column:
    """Without balanced ``::<...>``; an unclosed one takes the rest with it."""
    return _scanned(name, _after_colons, lambda out, inner: _cut(out), lambda out, rest: _cut(out))


def keep_impl_target(name: Column) -> Column:
    """``::<impl T for U>`` as ``::impl_for=U`` and ``::<impl U>`` as ``::impl=U``; text after an unclosed one as it is."""

    def closed(out: Column, inner: Column) -> Column:
        target = F.when(inner.contains(" for "), F.concat(F.lit("impl_for="), F.substring_index(inner, " for ", -1))).otherwise(F.concat(F.lit("impl="), F.substr(inner, F.lit(6))))
        return F.concat(out, F.when(inner.startswith("impl "), target).otherwise(F.concat(F.lit("<"), inner, F.lit(">"))))

    return _scanned(name, _after_colons, closed, lambda out, rest: F.concat(out, rest))


def outside(name: Column) -> Column:
    """The text outside brackets; an open bracket hides all that follows."""
    return _scanned(name, lambda tokens, i, done: F.lit(True), lambda out, inner: out, lambda out, rest: out)


def leading(name: Column) -> Column:
    """What a bracket at the beginning of the name holds; null where none begins it or it doesn't close."""

    def inside(tokens: Column) -> Column:
        first = F.get(F.filter(_pairs(tokens), lambda p: p["at"] == 0), 0)
        return F.when(first.isNotNull(), _joined(tokens, F.lit(1), first["end"]))

    return _let(_tokens(name), inside)


def drop_displayed_generics(name: Column) -> Column:
    """Without generic arguments. A pair is shown if it stands first in the name or in a shown pair, or holds a cast."""

    def with_tokens(tokens: Column) -> Column:
        def with_pairs(pairs: Column) -> Column:
            closed = F.transform(pairs, lambda p: p["at"])

            def step(acc: Column, p: Column) -> Column:
                outer = F.when(F.array_contains(closed, p["parent"]), p["parent"]).otherwise(F.lit(-1))
                hidden = (outer >= 0) & ~F.array_contains(acc["shown"], outer)
                turbo = F.coalesce(F.endswith(F.get(tokens, p["at"] - 1), F.lit("::")), F.lit(False))
                first = p["at"] == outer + 1
                state = lambda shown, out, done: F.struct(shown.cast("array<int>").alias("shown"), out.alias("out"), done.cast("int").alias("done"))
                before = F.concat(acc["out"], _joined(tokens, acc["done"], p["at"]))
                return (
                    F.when(hidden, state(acc["shown"], acc["out"], acc["done"])).when(~turbo & (p["casts"] | first), state(F.concat(acc["shown"], F.array(p["at"])), acc["out"], acc["done"]))
                    .otherwise(state(acc["shown"], F.when(turbo, _cut(before)).otherwise(before), p["end"] + 1))
                )

            zero = F.struct(F.array().cast("array<int>").alias("shown"), F.lit("").alias("out"), F.lit(0).alias("done"))
            return F.aggregate(pairs, zero, step, lambda acc: F.concat(acc["out"], _joined(tokens, acc["done"], F.size(tokens))))

        return _let(_pairs(tokens), with_pairs)

    return _let(_tokens(name), with_tokens)
