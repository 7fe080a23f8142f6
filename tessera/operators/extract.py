"""The relational core of evidence extraction, over a table of statements.

Statements: method_class, method, place, kind (invoke, assign), local (defined), callee_class, callee, argument, argument_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def application_classes(classes: DataFrame, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """Names equal to a prefix or below it."""

    def below(prefixes) -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | (F.col("class_name") == p) | F.col("class_name").startswith(f"{p}.")
        return out

    return classes.where(below(include) & ~below(exclude))


def type_rows(references: DataFrame, application: DataFrame) -> DataFrame:
    """(source, target, evidence_kind, evidence_location), arrays unwrapped, application classes only, once each, weight 1."""
    app = application.select(F.col("class_name").alias("target"))
    r = references.withColumn("target", F.regexp_replace("target", r"(?:\[\])+$", "")).where("source <> target")
    out = r.join(app, "target", "left_semi").join(app.withColumnRenamed("target", "source"), "source", "left_semi")
    return out.select("source", "target", F.lit("type").alias("dependency_type"), F.lit(1.0).alias("weight"), "evidence_kind", "evidence_location").distinct()


def call_rows(statements: DataFrame, application: DataFrame) -> DataFrame:
    app = application.select(F.col("class_name").alias("callee_class"))
    s = statements.where("kind = 'invoke' AND method_class <> callee_class").join(app, "callee_class", "left_semi")
    return s.select(F.col("method_class").alias("source"), F.col("callee_class").alias("target"), F.lit("call").alias("dependency_type"), F.lit(2.0).alias("weight"), F.lit("method_call").alias("evidence_kind"), F.concat_ws("#", "method", "place").alias("evidence_location")).distinct()


def return_flows(statements: DataFrame) -> DataFrame:
    """A call's result that another call takes as an argument: callee of the definition -> callee of the use, weight 3."""
    d = statements.where("local IS NOT NULL AND callee_class IS NOT NULL").select("method", F.col("local").alias("argument"), F.col("callee_class").alias("source"))
    u = statements.where("kind = 'invoke' AND argument IS NOT NULL").select("method", "argument", "place", F.col("callee_class").alias("target"))
    j = u.join(d, ["method", "argument"]).where("source <> target")
    return j.select("source", "target", F.lit("return_value_flow").alias("flow_type"), F.lit(3.0).alias("weight"), F.col("method").alias("evidence_method"), F.col("place").cast("string").alias("evidence_statement")).distinct()


def argument_flows(statements: DataFrame) -> DataFrame:
    """The argument's origin (its definition's class, else its declared type) -> the called class, weight 3."""
    d = statements.where("local IS NOT NULL AND callee_class IS NOT NULL").groupBy("method", F.col("local").alias("argument")).agg(F.min("callee_class").alias("defined"))
    u = statements.where("kind = 'invoke' AND argument IS NOT NULL")
    j = u.join(d, ["method", "argument"], "left").withColumn("source", F.coalesce("defined", "argument_type")).where("source IS NOT NULL AND source <> callee_class")
    return j.select("source", F.col("callee_class").alias("target"), F.lit("argument_passing_flow").alias("flow_type"), F.lit(3.0).alias("weight"), F.col("method").alias("evidence_method"), F.col("place").cast("string").alias("evidence_statement")).distinct()


def declared_methods(methods: DataFrame) -> DataFrame:
    return methods.where("name NOT IN ('<init>', '<clinit>') AND NOT synthetic AND NOT bridge")


def declaration_text(classes: DataFrame) -> DataFrame:
    """kind, name, extends, sorted implements and sorted distinct methods as one text."""
    part = lambda head, c: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.array_sort(F.array_distinct(c)), ", "))).otherwise("")
    return classes.select("class_id", F.concat("kind", F.lit(" "), "class_name", F.when(F.col("superclass").isNotNull(), F.concat(F.lit(" extends "), "superclass")).otherwise(""), part(" implements ", F.col("interfaces")), part(" methods ", F.col("methods"))).alias("declaration"))
