"""gradelens — outcome analytics for tables with an ordered categorical outcome.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark SQL expressions, so a whole report is one lazy Catalyst plan.

Layout
------
- ``gradelens.spec``        the outcome description (column, ordered levels, weights)
- ``gradelens.functions``   Column builders: predicates, bands, label folds, cleaning
- ``gradelens.operators``   DataFrame operators: breakdowns, association, folds,
                            ordering, grids, assembly, cleaning, profiles, quotas, model
- ``gradelens.sources``     parquet / CSV / JSON scans and sinks, code lists
- ``gradelens.plans``       named reports and the query catalog over the test tables
"""

from gradelens.spec import OutcomeSpec

__all__ = ["OutcomeSpec"]
__version__ = "0.1.0"
