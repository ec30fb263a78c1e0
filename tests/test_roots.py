"""Startup sequences and the order of root rules."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import roots

OPS = "source bigint, callsite bigint, text string, pointer bigint, is_call boolean, is_jump boolean, imm_target bigint, is_end boolean, whole boolean"


def ops(spark, listing, whole=True):
    rows = [(source, source + n, text, pointer, text.startswith("call"), text.startswith("jmp"), target, text.startswith(("ret", "hlt")), whole) for source, lines in listing.items() for n, (text, pointer, target) in enumerate(lines)]
    return spark.createDataFrame(rows, OPS).withColumn("graph_id", F.lit("g"))


ENTRY = [("lea rdi, [rip+1]", 500, None), ("call __libc_start_main", None, None)]
STORE = [("lea rax, [rip+1]", 14020, None), ("mov [rsp], rax", None, None), ("call rbx", None, None)]
TAIL = [("lea rdi, [rip+1]", 14040, None), ("jmp 900", None, 900)]
THROUGH = [("lea rdi, [rip+1]", 57712, None), ("call 900", None, 900)]
DEEP = [("lea rax, [rip+1]", 1, None), ("call 800", None, 800), ("ret", None, None), *[("nop", None, None)] * 20, ("lea rax, [rip+1]", 35440, None), ("mov qword [rsp], rax", None, None), ("call rbx", None, None)]


@pytest.mark.parametrize(("wrapper", "want"), [(STORE, 14020), (TAIL, 14040), (THROUGH, 57712), (DEEP, 35440)])
def test_startup(spark, wrapper, want):
    functions = spark.createDataFrame([("g", 100, "entry0"), ("g", 7, "main")], "graph_id string, address bigint, name string")
    row = roots.resolve_roots(functions, ops(spark, {100: ENTRY, 500: wrapper, 900: [("call rdi", None, None)], 800: [("ret", None, None)]})).first()
    assert (row["address"], row["how"]) == (want, "startup")


def test_rules(spark):
    functions = spark.createDataFrame([("g", 100, "entry0"), ("g", 7, "app.main"), ("h", 9, "other")], "graph_id string, address bigint, name string")
    none = ops(spark, {100: [("ret", None, None)]})
    assert [tuple(r) for r in roots.resolve_roots(functions, none).collect()] == [("g", 7, "main")]
    explicit = spark.createDataFrame([("g", 55)], "graph_id string, address bigint")
    assert roots.resolve_roots(functions, none, explicit).first()["address"] == 55
    assert roots.resolve_roots(functions, ops(spark, {100: ENTRY, 500: [("ret", None, None)]})).first()["address"] == 500
    assert roots.main_pointers(ops(spark, {500: DEEP}, whole=False)).isEmpty()
