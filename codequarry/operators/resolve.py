"""Symbol resolution over fact tables: exports, imports, calls and tests become typed relationships and errors.

Facts (ord is the order in the source):
    files    path, is_test
    symbols  symbol_id, name, kind, file_path, start_line, end_line, ord
    tests    test_id, file_path, start_line, end_line, ord
    imports  file_path, stmt, specifier, line, local, imported, is_default, is_namespace, ord (one row a name; stmt numbers the statement)
    exports  file_path, symbol_name, export_type, line, source_specifier, source_name, ord
    calls    file_path, called_name, call_type, line, arguments, ord

Every lookup that means "the first in the source" is a row_number over ord. Lookups join on file and name, so a hot name is spread by its files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import paths as P
from codequarry.operators.components import state
from codequarry.sources.shared import materialise, remove

#: Kinds that a call can resolve to; the name and last line of a file's module scope.
CALLABLE = ("function", "method", "const")
MODULE, LAST_LINE = "__module__", 999_999
#: Lines of a bucket in joins of lines with the scopes around them.
BUCKET = 256


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each of keys: the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def inside(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """points (file_path, line) with the scopes (file_path, start_line, end_line) of their file that hold their line.

    Scopes stand in every bucket of BUCKET lines that they reach, and points meet only those of their bucket: a file with many of both makes no product of them.
    """
    buckets = F.explode(F.sequence(F.floor(F.col("start_line") / BUCKET), F.floor(F.col("end_line") / BUCKET))).alias("_bucket")
    spread = scopes.where("end_line >= start_line").select("*", buckets)
    return points.withColumn("_bucket", F.floor(F.col("line") / BUCKET)).join(spread, ["file_path", "_bucket"]).where("line BETWEEN start_line AND end_line").drop("_bucket")


@dataclass(frozen=True)
class Facts:
    files: DataFrame
    symbols: DataFrame
    tests: DataFrame
    imports: DataFrame
    exports: DataFrame
    calls: DataFrame


class Resolver:
    """Resolves one set of facts. Each property is a DataFrame.

    What several steps read (targets of specifiers, own exports, the export map, methods, calls) is written once, so that no plan holds another's joins and windows again:
    the driver keeps the plan, code and stages of one step at a time.
    """

    def __init__(self, facts: Facts) -> None:
        self.facts = facts

    def specifiers(self) -> DataFrame:
        """file_path, specifier, target: the first candidate path that is a file, for every distinct specifier that has one."""
        return self._targets

    @cached_property
    def _targets(self) -> DataFrame:
        f = self.facts
        used = f.imports.select("file_path", "specifier").union(f.exports.where("source_specifier IS NOT NULL").select("file_path", "source_specifier")).distinct()
        tried = used.select("file_path", "specifier", F.posexplode(P.candidates(F.col("specifier"), F.col("file_path"))).alias("place", "target"))
        found = tried.join(f.files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
        return materialise(first_by(found, ["file_path", "specifier"], F.col("place")).select("file_path", "specifier", "target"), "specifiers")

    @cached_property
    def export_map(self) -> DataFrame:
        """file_path, name, symbol_id: what each file exports, through chains of re-exports, as a fixpoint.

        Later statements replace earlier ones; `export *` gives all but default and replaces nothing. Chains may be of any length: rounds go on until the map no longer
        changes. Where files re-export a name from one another in a cycle, their symbols could change places for ever; from the first map that
        comes again, each pair of file and name keeps its symbol, and only new pairs are added, of which there are finitely many.
        """
        f = self.facts
        local_name = F.coalesce("source_name", "symbol_name")
        own = f.exports.where("source_specifier IS NULL AND symbol_name <> '*'").select("file_path", "symbol_name", "export_type", local_name.alias("local_name"), F.col("ord").alias("at"))
        symbols = f.symbols.select(F.col("file_path").alias("s_file"), "name", "symbol_id", F.col("ord").alias("s_ord"))
        is_it = (F.col("s_file") == F.col("file_path")) & ((F.col("name") == F.col("local_name")) | ((F.col("export_type") == "default") & (F.col("name") == F.col("symbol_name"))))
        own = first_by(own.join(symbols, is_it), ["file_path", "at"], F.col("s_ord"))
        names = F.when(F.col("export_type") == "default", F.array("symbol_name", F.lit("default"))).otherwise(F.array("symbol_name"))
        own = materialise(own.select("file_path", F.explode(F.array_distinct(names)).alias("name"), "symbol_id", F.lit(0).alias("star"), (-F.col("at")).alias("rank")), "own-exports")

        passed = f.exports.where("source_specifier IS NOT NULL").select("file_path", F.col("source_specifier").alias("specifier"), "symbol_name", F.coalesce("source_name", "symbol_name").alias("source_name"), F.col("ord").alias("at"))
        passed = passed.join(self.specifiers(), ["file_path", "specifier"])
        passed = materialise(passed.select("file_path", "target", "symbol_name", "source_name", "at"), "re-exports")
        now = materialise(self._settled(own), "export-map")
        if passed.isEmpty():
            return now
        seen, kept = [state(now)], False
        while True:
            source = now.select(F.col("file_path").alias("target"), F.col("name").alias("source_name"), "symbol_id")
            named = passed.where("symbol_name <> '*'").join(source, ["target", "source_name"]).select("file_path", F.col("symbol_name").alias("name"), "symbol_id", F.lit(0).alias("star"), (-F.col("at")).alias("rank"))
            stars = passed.where("symbol_name = '*'").drop("source_name").join(source.where("source_name <> 'default'"), "target").select("file_path", F.col("source_name").alias("name"), "symbol_id", F.lit(1).alias("star"), F.col("at").alias("rank"))
            offered = self._settled(own.union(named).union(stars))
            then = materialise(now.union(offered.join(now, ["file_path", "name"], "left_anti")) if kept else offered, "export-map")
            after = state(then)
            remove(now)
            now = then
            if after == seen[-1]:
                return now
            kept = kept or after in seen
            seen.append(after)

    @staticmethod
    def _settled(offers: DataFrame) -> DataFrame:
        return first_by(offers, ["file_path", "name"], F.col("star"), F.col("rank"), F.col("symbol_id")).select("file_path", "name", "symbol_id")

    def export_edges(self) -> DataFrame:
        """file_path, line, symbol_name, export_type, symbol_id of local exports; symbol_id is null for a name the file doesn't define."""
        own = self.facts.exports.where("source_specifier IS NULL AND symbol_name <> '*'")
        return own.join(self.export_map.withColumnRenamed("name", "symbol_name"), ["file_path", "symbol_name"], "left").select("file_path", "line", "symbol_name", "export_type", "symbol_id", "ord")

    def import_edges(self) -> DataFrame:
        """file_path, stmt, specifier, line, status (external, resolved, unresolved), target: one row a statement."""
        statements = first_by(self.facts.imports, ["file_path", "stmt"], F.col("ord")).select("file_path", "stmt", "specifier", "line")
        inside = F.col("specifier").startswith("./") | F.col("specifier").startswith("../")
        joined = statements.join(self.specifiers(), ["file_path", "specifier"], "left")
        status = F.when(~inside, "external").when(F.col("target").isNotNull(), "resolved").otherwise("unresolved")
        return joined.select("file_path", "stmt", "specifier", "line", status.alias("status"), F.when(inside, F.col("target")).alias("target"))

    def _symbols(self, prefix: str) -> DataFrame:
        s = self.facts.symbols
        return s.select(F.col("symbol_id").alias(f"{prefix}_id"), F.col("kind").alias(f"{prefix}_kind"), F.col("file_path").alias(f"{prefix}_file"))

    def _bound(self) -> DataFrame:
        """file_path, local, symbol_id, kind: what an imported name stands for, by the first import that resolves."""
        mapped = first_by(self.facts.imports.where("local IS NOT NULL"), ["file_path", "stmt", "local"], F.col("ord")).select("file_path", "specifier", "stmt", "local", F.when(F.col("is_default"), "default").otherwise(F.col("imported")).alias("name"))
        found = mapped.join(self.specifiers(), ["file_path", "specifier"]).join(self.export_map.withColumnRenamed("file_path", "target"), ["target", "name"])
        found = first_by(found, ["file_path", "local"], F.col("stmt"))
        return materialise(found.join(self.facts.symbols.select("symbol_id", "kind"), "symbol_id").select("file_path", "local", "symbol_id", "kind"), "bound")

    def _methods(self) -> DataFrame:
        """file_path, class_name, class_ord, method, symbol_id: the first method of a name inside each class."""
        s = self.facts.symbols
        classes = s.where("kind = 'class'").select("file_path", F.col("symbol_id").alias("class_id"), F.col("name").alias("class_name"), F.col("ord").alias("class_ord"), "start_line", "end_line")
        methods = s.where("kind = 'method'").select("file_path", F.col("name").alias("method"), "symbol_id", "ord", F.col("start_line").alias("line"), F.col("end_line").alias("m_to"))
        within = inside(methods, classes).where("m_to <= end_line")
        found = first_by(within, ["file_path", "class_id", "method"], F.col("ord")).select("file_path", "class_name", "class_ord", "method", "symbol_id")
        return materialise(found, "methods")

    @cached_property
    def calls(self) -> DataFrame:
        """Every call with category, caller_id, callee_id, callee_file, confidence (null where unresolved) and error category."""
        f = self.facts
        calls = f.calls.select("file_path", "ord", "called_name", "call_type", "line", F.substring_index("called_name", ".", 1).alias("base"), F.when(F.col("called_name").contains("."), F.expr("substr(called_name, locate('.', called_name) + 1)")).alias("member"))
        key = ["file_path", "ord"]

        local = first_by(f.symbols, ["file_path", "name"], F.col("ord")).select("file_path", F.col("name").alias("called_name"), F.col("symbol_id").alias("local_id"), F.col("kind").alias("local_kind"))
        bound = self._bound().select("file_path", F.col("local").alias("called_name"), F.col("symbol_id").alias("bound_id"), F.col("kind").alias("bound_kind"))
        passed = f.calls.select("file_path", F.explode("arguments").alias("called_name")).distinct().withColumn("passed", F.lit(True))
        plain = calls.join(local, ["file_path", "called_name"], "left").join(bound, ["file_path", "called_name"], "left").join(passed, ["file_path", "called_name"], "left")

        methods = self._methods()
        own = first_by(methods, ["file_path", "method"], F.col("class_ord")).select("file_path", F.col("method").alias("member"), F.col("symbol_id").alias("this_id"))
        classes = first_by(f.symbols.where("kind = 'class'"), ["file_path", "name"], F.col("ord")).select("file_path", F.col("name").alias("base"), F.col("ord").alias("class_ord"), F.lit(True).alias("is_class"))
        static = methods.select("file_path", "class_ord", F.col("method").alias("member"), F.col("symbol_id").alias("static_id"))
        spaces = first_by(f.imports.where("is_namespace"), ["file_path", "local"], F.col("stmt")).select("file_path", F.col("local").alias("base"), "specifier").join(self.specifiers(), ["file_path", "specifier"])
        in_space = spaces.join(self.export_map.select(F.col("file_path").alias("target"), F.col("name").alias("member"), F.col("symbol_id").alias("space_id")), "target").join(f.symbols.where(F.col("kind").isin(*CALLABLE)).select(F.col("symbol_id").alias("space_id")), "space_id", "left_semi").select("file_path", "base", "member", "space_id")
        plain = plain.join(own, ["file_path", "member"], "left").join(classes, ["file_path", "base"], "left").join(static, ["file_path", "class_ord", "member"], "left").join(in_space, ["file_path", "base", "member"], "left")

        direct, method = F.col("call_type") == "direct", F.col("call_type") == "method"
        by_name = F.when(F.col("local_kind").isin(*CALLABLE), F.col("local_id")).when(F.col("bound_kind").isin(*CALLABLE), F.col("bound_id"))
        by_member = F.when(F.col("base") == "this", F.col("this_id")).when(F.col("is_class"), F.col("static_id")).otherwise(F.col("space_id"))
        category = (
            F.when(F.col("call_type") == "dynamic", "dynamic").when(method, "method").when(F.col("local_id").isNotNull(), "sameFile")
            .when(F.col("bound_id").isNotNull(), "imported").when(F.col("passed"), "callback").otherwise("builtin")
        )
        callee = F.when(direct, by_name).when(method & F.col("member").isNotNull(), by_member)
        trusted = F.when(direct | ((F.col("base") != "this") & F.col("is_class").isNull()), "high").otherwise("medium")
        resolved = materialise(plain.select(*key, "called_name", "call_type", "line", category.alias("category"), callee.alias("callee_id"), trusted.alias("confidence")), "resolved")

        scopes = f.symbols.select("file_path", F.col("symbol_id").alias("caller_id"), "start_line", "end_line", F.col("ord").alias("s_ord"))
        around = inside(f.calls.select("file_path", "ord", "line"), scopes)
        around = first_by(around, key, F.desc("start_line"), F.desc("s_ord")).select(*key, "caller_id")
        module = F.concat("file_path", F.lit(f":{MODULE}:1"))
        named = resolved.join(around, key, "left").join(self._symbols("callee").drop("callee_kind"), "callee_id", "left")
        error = F.when(F.col("callee_id").isNull() & (F.col("call_type") != "dynamic"), F.when(method | F.col("called_name").contains("."), "ambiguous").otherwise("not_found"))
        confidence = F.when(F.col("callee_id").isNotNull(), F.col("confidence"))
        found = named.select(*key, "called_name", "call_type", "line", "category", F.coalesce("caller_id", module).alias("caller_id"), "callee_id", "callee_file", confidence.alias("confidence"), error.alias("error"))
        return materialise(found, "calls")

    def counters(self) -> DataFrame:
        """counter, n: calls by category (total, resolved), by confidence and across files; imports by status; exports that are local and re-exports."""
        calls = self.calls.withColumn("resolved", F.col("callee_id").isNotNull())
        named = lambda *parts: F.concat_ws(".", *[F.lit(x) if i != 1 else F.col(x) for i, x in enumerate(parts)])
        every = [
            calls.select(F.explode(F.array(named("calls", "category", "total"), F.when(F.col("resolved"), named("calls", "category", "resolved")), F.when(F.col("resolved"), named("calls", "confidence")), F.when(F.col("callee_file") != F.col("file_path"), F.lit("calls.cross_file")))).alias("counter")),
            self.import_edges().select(named("imports", "status").alias("counter")),
            self.facts.exports.select(F.when(F.col("source_specifier").isNull(), F.lit("exports.local")).otherwise(F.lit("exports.re_exported")).alias("counter")),
        ]
        return reduce(DataFrame.union, every).where("counter IS NOT NULL").groupBy("counter").agg(F.count(F.lit(1)).alias("n"))

    def call_edges(self) -> DataFrame:
        return self.calls.where("callee_id IS NOT NULL").select("caller_id", "callee_id", "call_type", "confidence", "line")

    def tested_by(self) -> DataFrame:
        """symbol_id, test_id, coverage_type, confidence: one row a call (direct), or one a directly called symbol and call of it (indirect)."""
        f = self.facts
        test_files = f.files.where("is_test").select(F.col("path").alias("file_path"))
        outside = lambda df, column: df.join(f.files.where("is_test").select(F.col("path").alias(column)), column, "left_anti")
        made = self.calls.where("callee_id IS NOT NULL").join(test_files, "file_path", "left_semi")
        tests = f.tests.where("start_line IS NOT NULL AND end_line IS NOT NULL").select("file_path", "test_id", "start_line", "end_line", F.col("ord").alias("t_ord"))
        around = first_by(inside(made.select("file_path", "ord", "line"), tests), ["file_path", "ord"], F.desc("start_line"), F.desc("t_ord")).select("file_path", "ord", "test_id")
        whole = F.concat("file_path", F.lit(":file"))
        direct = outside(made, "callee_file").join(around, ["file_path", "ord"], "left").select(F.col("callee_id").alias("symbol_id"), F.coalesce("test_id", whole).alias("test_id"), F.lit("direct").alias("coverage_type"), "confidence")
        seen = made.select("file_path", F.col("callee_id").alias("caller_id")).distinct()
        further = outside(self.calls.where("callee_id IS NOT NULL").select("caller_id", "callee_id", "callee_file"), "callee_file")
        indirect = seen.join(further, "caller_id").select(F.col("callee_id").alias("symbol_id"), whole.alias("test_id"), F.lit("indirect").alias("coverage_type"), F.lit("low").alias("confidence"))
        return direct.union(indirect)

    def errors(self) -> DataFrame:
        """type, file, line, message, category."""
        exports = self.export_edges().where("symbol_id IS NULL").select(F.lit("ambiguous_symbol").alias("type"), F.col("file_path").alias("file"), "line", F.concat(F.lit("Exported symbol '"), "symbol_name", F.lit("' not found in file")).alias("message"), F.lit("not_found").alias("category"))
        imports = self.import_edges().where("status = 'unresolved'").select(F.lit("unresolved_import"), "file_path", "line", F.concat(F.lit("Could not resolve import '"), "specifier", F.lit("'")), F.lit("not_found"))
        calls = self.calls.where("error IS NOT NULL").select(F.lit("unresolved_call"), "file_path", "line", F.concat(F.lit("Could not resolve call to '"), "called_name", F.lit("'")), "error")
        return exports.union(imports).union(calls)

    def exported(self) -> DataFrame:
        """symbols with is_exported: those that their own file exports."""
        out = self.export_edges().where("symbol_id IS NOT NULL").select("symbol_id", F.lit(True).alias("is_exported")).distinct()
        return self.facts.symbols.join(out, "symbol_id", "left").withColumn("is_exported", F.coalesce("is_exported", F.lit(False)))

    def relationships(self) -> DataFrame:
        """from_id, to_id, rel_type, call_site_line, one row for each edge."""
        none = F.lit(None).cast("int").alias("call_site_line")
        exports = self.export_edges().where("symbol_id IS NOT NULL").select(F.col("file_path").alias("from_id"), F.col("symbol_id").alias("to_id"), F.lit("EXPORTS").alias("rel_type"), none)
        imports = self.import_edges().where("status = 'resolved'").select("file_path", "target", F.lit("IMPORTS"), none)
        calls = self.call_edges().select("caller_id", "callee_id", F.lit("CALLS"), "line")
        tests = self.tested_by().select("symbol_id", "test_id", F.lit("TESTED_BY"), none)
        return exports.union(imports).union(calls).union(tests)


def failure_classes(errors: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "unresolved_import", "parser limitation").when(F.col("type") == "ambiguous_symbol", "resolver limitation").when(F.col("category") == "ambiguous", "ambiguous code").otherwise("resolver limitation")
    return errors.groupBy(kind.alias("failure")).agg(F.count(F.lit(1)).alias("n"))


def top_unresolved(errors: DataFrame, n: int = 6) -> DataFrame:
    """message, n of the most frequent errors; ties by message. A trailing :line is cut from calls."""
    message = F.when(F.col("type") == "unresolved_call", F.regexp_replace("message", ":[0-9]+$", "")).otherwise(F.col("message"))
    return errors.groupBy(message.alias("message")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "message").limit(n)
