"""Structure of code from its lines (path, line, code): nesting, extent and complexity of functions, parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a function begins, what opens a branch, and the limits of the checks.
BEGINS = [r"^(?:export\s+)?(?:async\s+)?(?:static\s+)?function\s+(\w+)", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(", r"^\s*(?:public|private|protected|static|async)?\s*(\w+)\s*\([^)]*\)\s*(?::\s*\w+(?:<[^>]*>)?)?\s*\{"]
BRANCHES = [r"\bif\b", r"\belse\s+if\b", r"\bcase\b", r"\bdefault\s*:", r"\bfor\b", r"\bwhile\b", r"\bcatch\b"]
PARAMS = r"(?:function\s+\w+\s*|=>\s*|\w+\s*)\s*\(([^)]*)\)"
LIMITS = {"lines": 50, "params": 5, "nesting": 4, "complexity": 15}


def _count(code: Column, letter: str) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit(letter), F.lit("")))


def depths(lines: DataFrame) -> DataFrame:
    """path, line, code, step, depth: braces opened less closed on a line, and up to and with it: a prefix sum over each path's lines."""
    code = F.coalesce("code", F.lit(""))
    rows = lines.select("path", "line", code.alias("code")).withColumn("step", _count(F.col("code"), "{") - _count(F.col("code"), "}"))
    return rows.withColumn("depth", F.sum("step").over(Window.partitionBy("path").orderBy("line")))


def nesting(lines: DataFrame, above: int = LIMITS["nesting"]) -> DataFrame:
    """path, line, depth of lines that open a level deeper than ``above``."""
    return depths(lines).where((F.col("depth") > above) & (F.col("step") > 0)).select("path", "line", "depth")


def functions(lines: DataFrame) -> DataFrame:
    """path, name, start, end, lines, complexity, closed of the outermost functions.

    A function begins on a line that one of BEGINS finds; it ends on the first line, two or more below, on which its braces are closed:
    the next line at the depth it began at. One that never closes goes to the last line (closed is false). What begins inside
    another function is part of it. complexity: 1 and one for each of BRANCHES found on a line of it. Lines count from any number.
    """
    trimmed = F.trim("code")
    name = F.coalesce(*[F.nullif(F.regexp_extract(trimmed, p, 1), F.lit("")) for p in BEGINS])
    hits = sum((F.when(trimmed.rlike(p), 1).otherwise(0) for p in BRANCHES), F.lit(0))
    by_path = Window.partitionBy("path").orderBy("line")
    rows = depths(lines).withColumn("name", name).withColumn("at", F.col("depth") - F.col("step")).withColumn("nth", F.row_number().over(by_path)).withColumn("upto", F.sum(hits).over(by_path)).withColumn("own", hits)
    # A head asks, from two lines below, for the next line that ends at the depth it begins at.
    asks = rows.where("name is not null").select("path", F.col("at").alias("level"), (F.col("nth") + 2).alias("place"), F.lit(0).alias("kind"), "name", F.col("line").alias("start"), F.col("nth").alias("first"), (F.col("upto") - F.col("own")).alias("before"), F.lit(None).cast("struct<line:bigint,nth:bigint,upto:bigint>").alias("stop"))
    ends = rows.select("path", F.col("depth").alias("level"), F.col("nth").alias("place"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("before"), F.struct(F.col("line").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"), F.col("upto").cast("long").alias("upto")).alias("stop"))
    following = Window.partitionBy("path", "level").orderBy("place", "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = asks.unionByName(ends).withColumn("next", F.first("stop", ignorenulls=True).over(following)).where("kind = 0")
    last = rows.groupBy("path").agg(F.max_by(F.struct(F.col("line").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"), F.col("upto").cast("long").alias("upto")), "line").alias("last"))
    heads = met.join(last, "path").withColumn("closed", F.col("next").isNotNull()).withColumn("stop", F.coalesce("next", "last"))
    head = F.struct("first", F.col("start"), "name", (F.col("stop.line")).alias("end"), F.col("stop.nth").alias("final"), (F.col("stop.upto") - F.col("before") + 1).alias("complexity"), "closed")
    per_path = heads.groupBy("path").agg(F.array_sort(F.collect_list(head)).alias("h"))
    kind = per_path.schema["h"].dataType.simpleString()
    kept = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("to"), F.array().cast(kind).alias("out")), lambda s, x: F.when(x["first"] > s["to"], F.struct(x["final"].cast("long").alias("to"), F.array_append(s["out"], x).alias("out"))).otherwise(s))
    return per_path.select("path", F.explode(kept["out"]).alias("f")).select("path", "f.name", "f.start", "f.end", (F.col("f.final") - F.col("f.first") + 1).alias("lines"), "f.complexity", "f.closed")


def parameters(lines: DataFrame) -> DataFrame:
    """path, line, params: how many parameters the first list of a line has; empty ones and ``...`` do not count."""
    found = F.transform(F.split(F.regexp_extract("code", PARAMS, 1), ","), lambda p: F.trim(p))
    return lines.where(F.col("code").rlike(PARAMS)).select("path", "line", F.size(F.filter(found, lambda p: (p != "") & (p != "..."))).alias("params"))


def structural_findings(lines: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """path, line, rule, value of what exceeds a limit: max-function-lines, max-params, max-nesting-depth, max-cyclomatic-complexity."""
    most = LIMITS | (limits or {})
    f = functions(lines)
    row = lambda df, line, rule, value: df.select("path", F.col(line).cast("long").alias("line"), F.lit(rule).alias("rule"), F.col(value).cast("long").alias("value"))
    return (
        row(f.where(F.col("lines") > most["lines"]), "start", "max-function-lines", "lines")
        .unionByName(row(f.where(F.col("complexity") > most["complexity"]), "start", "max-cyclomatic-complexity", "complexity"))
        .unionByName(row(parameters(lines).where(F.col("params") > most["params"]), "line", "max-params", "params"))
        .unionByName(row(nesting(lines, most["nesting"]), "line", "max-nesting-depth", "depth"))
    )


def graph_findings(nodes: DataFrame, edges: DataFrame, most_coupled: int = 10, entry_labels: tuple[str, ...] = ("Route", "Module", "File")) -> DataFrame:
    """id, rule, value: coupling (distinct neighbours over ``most_coupled``), dead code (no edge in, not exported, no entry), cycles of two (with the other end)."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()
    coupled = both.groupBy("id").agg(F.count("*").alias("value")).where(F.col("value") > most_coupled).select("id", F.lit("coupling").alias("rule"), "value")
    dead = nodes.where(~F.coalesce("exported", F.lit(False)) & ~F.col("label").isin(*entry_labels)).join(e.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit("dead-code").alias("rule"), F.lit(0).cast("long").alias("value"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    cyclic = e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("id"), F.lit("cycle").alias("rule"), F.col("dst").alias("value"))
    return coupled.unionByName(dead).unionByName(cyclic)


#: The keywords of constructs, of jumps and of what follows a closing brace.
HEADS = {"if": r"(?:else\s+)?if\b", "loop": r"(?:for|while)\b", "switch": r"switch\b", "try": r"try\b", "else": r"(?:else|finally)\b", "catch": r"catch\b"}


def flow_edges(text: str) -> list[tuple[int, int, str]]:
    """(src, dst, kind) between the lines of one text of a language with braces, a statement a line: 0 is the entry, one past the last line the exit.

    kind: next, true and false of a branch or loop, case and default of a switch, back to a loop's head, throw from a try to its catch.
    Lines of closing braces alone are no blocks. A jump that nothing encloses goes to the exit.
    """
    import re

    lines = text.split("\n")
    edges: set[tuple[int, int, str]] = set()
    exit_, live, stack = len(lines) + 1, [(0, "next")], []

    def enter(i: int) -> None:
        edges.update((s, i, kind) for s, kind in live)

    def around(*kinds: str) -> dict | None:
        return next((c for c in reversed(stack) if c["kind"] in kinds), None)

    for i, code in enumerate(lines, 1):
        s, closed = code.strip(), None
        while s.startswith("}") and stack:
            closed, s = stack.pop(), s[1:].strip(" ;)")
            follows = re.match(r"(?:else|catch|finally)\b", s)
            if closed["kind"] == "loop":
                edges.update((src, closed["head"], "back") for src, _ in live)
                live = [(closed["head"], "false"), *closed["leave"]]
            elif closed["kind"] == "switch":
                live = live + closed["leave"] + ([] if closed["default"] else [(closed["head"], "default")])
            elif closed["kind"] == "if" and follows:
                closed["after"], live = closed["after"] + live, [(closed["head"], "false")]
            elif closed["kind"] == "if":
                live = live + closed["after"] + [(closed["head"], "false")]
            elif closed["kind"] == "try" and follows:
                closed["after"], live = closed["after"] + live, [(closed["head"], "throw")]
            else:
                live = live + closed["after"]
            if not follows:
                closed = None
        s = s.lstrip("}")
        if not s:
            continue
        if re.match(r"(?:case\b|default\s*:)", s) and (c := around("switch")):
            c["default"] |= s.startswith("default")
            live = live + [(c["head"], "default" if s.startswith("default") else "case")]
        enter(i)
        live = [(i, "next")]
        kind = next((k for k, p in HEADS.items() if re.match(p, s)), "block")
        if s.endswith("{"):
            after = closed["after"] if closed else []
            stack.append({"kind": kind, "head": i, "after": after, "leave": [], "default": False})
            live = {"if": [(i, "true")], "loop": [(i, "true")], "switch": []}.get(kind, live)
        elif re.match(r"(?:return|throw)\b", s):
            edges.add((i, exit_, "next"))
            live = []
        elif re.match(r"break\b", s) or re.match(r"continue\b", s):
            c = around("loop") if s.startswith("continue") else around("loop", "switch")
            if c is None:
                edges.add((i, exit_, "next"))
            elif s.startswith("continue"):
                edges.add((i, c["head"], "back"))
            else:
                c["leave"].append((i, "next"))
            live = []
    enter(exit_)
    return sorted(edges)


def control_flow(files: DataFrame) -> DataFrame:
    """fn, src, dst, kind: the control flow of each text (path, text) as ``flow_edges`` has it; fn is the path. A null text has one edge, from entry to exit.

    One row is one file, so a task holds one text at a time. The result is what ``dataflow`` takes as edges.
    """
    import pandas as pd

    def run(frames):
        for pdf in frames:
            rows = [(p, *e) for p, t in zip(pdf["path"], pdf["text"]) for e in flow_edges(t if isinstance(t, str) else "")]
            yield pd.DataFrame(rows, columns=["fn", "src", "dst", "kind"])

    return files.select("path", "text").mapInPandas(run, "fn string, src long, dst long, kind string")


#: Labels of nodes that hotspots are looked for among.
STRUCTURAL = ("Function", "Method", "Class", "Interface", "Module", "Component", "Service", "Controller", "Handler", "Route", "Endpoint", "Resolver")


def structural(nodes: DataFrame, labels: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """Nodes with a structural label."""
    return nodes.where(F.col("label").isin(*labels))
