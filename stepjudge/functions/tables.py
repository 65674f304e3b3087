"""Explosions as SQL table functions (U6): names for ``spark.sql``, defined in SQL, so they run where built-in ones do.

    register(spark)
    SELECT d.doc_id, s.step_idx, s.step FROM documents d, LATERAL text_steps(d.text) s
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, body)
FUNCTIONS = {
    "text_steps": (
        "t STRING", "step_idx BIGINT, step STRING",
        r"SELECT CAST(pos AS BIGINT), col FROM posexplode(filter(transform(split(t, '\\n', -1), x -> regexp_replace(x, '(?U)^\\s+|\\s+$', '')), x -> x <> ''))",
    ),
    "text_segments": (
        "t STRING, mark STRING", "segment_idx BIGINT, segment STRING",
        r"SELECT CAST(pos AS BIGINT), col FROM posexplode(split(t, concat('\\Q', mark, '\\E'), -1))",
    ),
    "sweep_sizes": (
        "n BIGINT", "size BIGINT",
        "SELECT CAST(pow(2, col) AS BIGINT) FROM explode(sequence(0, CAST(floor(log2(greatest(n, 1))) AS INT))) WHERE n >= 1",
    ),
}


def register(spark: SparkSession) -> None:
    """Define the functions in this session: ``text_steps`` (non-empty lines, trimmed, numbered from 0), ``text_segments``
    (the parts between a mark) and ``sweep_sizes`` (1, 2, 4, … up to n)."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE ({gives}) RETURN {body}")
