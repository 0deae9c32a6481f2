"""switchyard: message-routing analytics as Spark DataFrame transformations.

Label, clean, deduplicate, split, profile, featurise, score, route and evaluate short-text
messages.  Every public function takes and returns a ``DataFrame`` (or builds a ``Column``), so
Catalyst sees one declarative plan and picks the physical strategy.
"""
