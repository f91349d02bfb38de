"""Retail price intelligence as Spark jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function (or a ``Column``
builder); nothing here runs an action unless its name starts with ``write_``
or ``run_``.
"""
