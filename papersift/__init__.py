"""papersift: a Spark-native paper triage and digest engine.

Every public function maps DataFrame(s) to a DataFrame and stays lazy, except
for the few places that must act (a model fit, one-row stratum counts, and
"""

from papersift.settings import Settings

__all__ = ["Settings"]
