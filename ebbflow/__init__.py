"""ebbflow: demand-planning analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``DataFrame.transform``) that runs over all series in one distributed job.
"""

__version__ = "0.1.0"
