"""tagweave: caption and tag curation as Spark jobs.

Every public function is ``DataFrame (+ args) -> DataFrame`` or
``Column -> Column``; none of them runs an action unless its name says
it writes something.
"""

__version__ = "0.1.0"
