"""stepjudge — step verification, answer voting and evaluation as Spark DataFrame operators.

Sub-packages:

* ``sources``   — readers, writers and the fixture views over the driver tables
* ``functions`` — Column functions (answer text, verdict parsing, equality, prompts)
* ``operators`` — table operators (rows, ranking, steps, votes, metrics, scoring, sequences)
* ``plans``     — named compositions (curation, grading, calibration, search) and the query catalog
* ``streaming`` — the same Column functions applied to a file stream
"""

from stepjudge.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
