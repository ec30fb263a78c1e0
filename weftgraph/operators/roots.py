"""Choice of a graph's root: explicit, by the startup chain, by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

FUNCTION = ["graph_id", "source"]
#: Fixed texts of startup code: the library entry that takes the real main, the marker of the language's own start, the
#: stores that pass a pointer on the stack, and the call through the first argument's register.
LIBRARY_START, LANGUAGE_START = "__libc_start_main", "lang_start_internal"
STACK_STORES = ("mov qword [rsp], rax", "mov [rsp], rax")
REGISTER_CALL, REGISTER_CALL_WITHIN = "call rdi", 8


def wrapper_pointers(ops: DataFrame) -> DataFrame:
    """(graph_id, source, pointer): the last ``lea rdi`` before a function's first call of the library start."""
    before = Window.partitionBy(*FUNCTION).orderBy("callsite").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("text").startswith("lea rdi,"), F.col("pointer")), ignorenulls=True).over(before)
    found = ops.withColumn("held", last).where(F.col("text").contains(LIBRARY_START) & F.col("held").isNotNull())
    return found.groupBy(*FUNCTION).agg(F.min_by("held", "callsite").alias("pointer"))


def main_pointers(ops: DataFrame) -> DataFrame:
    """(graph_id, source, pointer): the pointer that a start wrapper hands on.

    ops: (graph_id, source, callsite, text, pointer, is_call, is_jump, imm_target, is_end, whole). Transfers and ends
    cut a function into stretches. A stretch's pointer is its last ``lea`` into rax or rdi; the transfer that closes the
    stretch confirms it by its text, by a store of rax after the ``lea``, or, for rdi, by being a jump or by calling a
    routine that soon calls through rdi. Without a known extent (``whole`` is false), nothing after an end counts.
    """
    order = Window.partitionBy(*FUNCTION).orderBy("callsite")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    transfer = F.col("is_call") | F.col("is_jump")
    rows = ops.withColumn("stretch", F.coalesce(F.count_if(transfer | F.col("is_end")).over(earlier), F.lit(0)))
    rows = rows.withColumn("ended", F.coalesce(F.count_if("is_end").over(earlier), F.lit(0)) > 0).where("whole or not ended")
    into = F.regexp_extract("text", r"^lea (rax|rdi),", 1)
    loads = F.when((into != "") & F.col("pointer").isNotNull(), F.struct("callsite", "pointer", into.alias("register")))
    within = Window.partitionBy(*FUNCTION, "stretch").orderBy("callsite").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("load", F.last(loads, ignorenulls=True).over(within)).withColumn("store", F.max(F.when(F.col("text").isin(*STACK_STORES), F.col("callsite"))).over(within))
    first = ops.withColumn("place", F.row_number().over(order)).where((F.col("place") <= REGISTER_CALL_WITHIN) & (F.trim("text") == REGISTER_CALL))
    callers = first.select("graph_id", F.col("source").alias("imm_target"), F.lit(True).alias("calls_on")).distinct()
    rows = rows.where(transfer & F.col("load").isNotNull()).join(callers, ["graph_id", "imm_target"], "left")
    by_register = (F.col("load.register") == "rdi") & (F.col("is_jump") | F.coalesce("calls_on", F.lit(False)))
    sure = F.col("text").contains(LANGUAGE_START) | F.coalesce(F.col("store") > F.col("load.callsite"), F.lit(False)) | by_register
    return rows.where(sure).groupBy(*FUNCTION).agg(F.min_by("load.pointer", "callsite").alias("pointer"))


def named(functions: DataFrame, name: str) -> DataFrame:
    """(graph_id, address) of the function of that name, else of the first whose name ends with it."""
    rank = F.when(F.col("name") == name, 0).when(F.col("name").endswith(name), 1)
    return functions.where(rank.isNotNull()).groupBy("graph_id").agg(F.min_by("address", F.struct(rank, F.col("address"))).alias("address"))


def resolve_roots(functions: DataFrame, ops: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(graph_id, address, how) of each graph's root, by the first rule that finds one.

    The rules: an explicit root, the startup chain from ``entry0`` (its wrapper where the wrapper hands nothing on),
    ``main``, ``sym.main``, ``entry0``. Graphs without any are absent; ``explicit`` holds (graph_id, address).
    """
    entry = named(functions, "entry0")
    wrapper = wrapper_pointers(ops).join(entry.withColumnRenamed("address", "source"), FUNCTION, "left_semi").select("graph_id", F.col("pointer").alias("source"))
    chain = wrapper.join(main_pointers(ops), FUNCTION, "left").select("graph_id", F.coalesce("pointer", "source").alias("address"))
    rules = [("startup", chain), ("main", named(functions, "main")), ("sym.main", named(functions, "sym.main")), ("entry0", entry)]
    rules = ([("explicit", explicit.select("graph_id", "address"))] if explicit is not None else []) + rules
    found = reduce(DataFrame.unionByName, [df.withColumns({"how": F.lit(how), "rank": F.lit(i)}) for i, (how, df) in enumerate(rules)])
    return found.groupBy("graph_id").agg(F.min_by(F.struct("address", "how"), "rank").alias("root")).select("graph_id", "root.address", "root.how")
