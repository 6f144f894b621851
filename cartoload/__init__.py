"""cartoload: geospatial bulk ingest and load catalogue as Spark jobs.

``scan`` and ``infer_schema`` take the options of one source, ``classify`` a column of options,
``stage`` loads a scan, ``run_load`` and ``run_workflow`` load a whole manifest. The catalogue views,
checks and changes are in ``cartoload.operators``.
"""

from cartoload.operators.stage import export_csv, stage, stage_table
from cartoload.plans.load_job import run_load, run_workflow
from cartoload.session import configure
from cartoload.sources.dispatch import infer_schema, scan
from cartoload.sources.manifest import classify

__all__ = ["classify", "configure", "export_csv", "infer_schema", "run_load", "run_workflow", "scan", "stage", "stage_table"]
