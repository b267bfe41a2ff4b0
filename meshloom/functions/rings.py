"""Small cyclic orders as columns: things that share ends, put one after another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shape import let


def chained(items: Column) -> Column:
    """(order, fans, closed) of items, an array of structs with the ends `a` and `b`: their places in the order in which they share ends.

    Runs begin at the first item of which no other item has one of the ends, else at the first that is left; from each item the run
    goes on over its end b, then over a, to the first item left. fans counts the runs; closed tells that the only
    one came back to its beginning. The work grows with the square of the array's size, which is what
    meets at one vertex or edge.
    """
    every = F.transform(items, lambda x, i: F.struct(i.alias("i"), x["a"].alias("a"), x["b"].alias("b")))

    def marked(all_: Column) -> Column:
        lone = lambda v: F.size(F.filter(all_, lambda y: (y["a"] == v) | (y["b"] == v))) == 1
        return F.transform(all_, lambda x: F.struct(x["i"].alias("i"), x["a"].alias("a"), x["b"].alias("b"), (lone(x["a"]) | lone(x["b"])).alias("open")))

    def walk(all_: Column) -> Column:
        no_index = F.lit(-1)
        begin = F.struct(F.array().cast("array<int>").alias("order"), all_.alias("left"), F.lit(0).alias("fans"), F.lit(True).alias("closed"), no_index.alias("now"))

        def step(s: Column, _: Column) -> Column:
            now = F.get(all_, s["now"])
            touching = lambda end: F.get(F.filter(s["left"], lambda y: (s["now"] >= 0) & ((y["a"] == end) | (y["b"] == end))), F.lit(0))
            on = F.coalesce(touching(now["b"]), touching(now["a"]))
            new = F.coalesce(F.get(F.filter(s["left"], lambda y: y["open"]), F.lit(0)), F.get(s["left"], F.lit(0)))

            def put(pick: Column) -> Column:
                fresh = on.isNull()
                return F.struct(
                    F.concat(s["order"], F.array(pick["i"])).alias("order"),
                    F.filter(s["left"], lambda y: y["i"] != pick["i"]).alias("left"),
                    (s["fans"] + fresh.cast("int")).alias("fans"),
                    (s["closed"] & ~(fresh & pick["open"])).alias("closed"),
                    pick["i"].alias("now"),
                )

            return let(F.coalesce(on, new), put)

        return F.aggregate(all_, begin, step, lambda s: F.struct(s["order"].alias("order"), s["fans"].alias("fans"), (s["closed"] & (s["fans"] == 1)).alias("closed")))

    return let(let(every, marked), walk)
