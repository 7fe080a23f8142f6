"""Column functions of the operators, in one place."""

from tessera.operators.fronts import dominates, imbalance_bound, normalized
from tessera.operators.graph import configured_weight, normalized_weight, weight_or_zero
from tessera.operators.partition import canonical_labels, safe_ratio
from tessera.operators.selection import relative_gain, relative_loss
from tessera.operators.stats import average_rank, relative_delta, snapped_delta, two_sided_p
from tessera.operators.text import clean_identifier, compose, declaration_of, literal_class, nfkc, normal_type, package_of, scaled, simple_name, split_identifier, vector_hash
from tessera.operators.vectors import cosine, norm

__all__ = [
    "average_rank", "canonical_labels", "clean_identifier", "compose", "configured_weight", "cosine", "declaration_of", "dominates", "imbalance_bound", "literal_class", "nfkc", "norm", "normal_type",
    "normalized", "normalized_weight", "package_of", "relative_delta", "relative_gain", "relative_loss", "safe_ratio", "scaled", "simple_name", "snapped_delta", "split_identifier", "two_sided_p", "vector_hash", "weight_or_zero",
]

#: Functions on Arrow batches, under the names that SQL gets them by.
SQL_NAMES = {"nfkc": nfkc, "vector_hash": vector_hash, "two_sided_p": two_sided_p}
#: SQL functions over built-in expressions: name, parameters, result, body.
SQL_BODIES = (
    ("simple_name", "name STRING", "STRING", r"regexp_extract(name, r'([^.$]*)$', 1)"),
    ("package_of", "name STRING", "STRING", r"if(locate('.', name) > 0, regexp_replace(name, r'\.[^.]*$', ''), '')"),
    ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
)


def register(spark) -> list[str]:
    """Make the functions known to spark.sql; returns their names."""
    for name, f in SQL_NAMES.items():
        spark.udf.register(name, f)
    for name, parameters, result, body in SQL_BODIES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [*SQL_NAMES, *(name for name, *_ in SQL_BODIES)]
