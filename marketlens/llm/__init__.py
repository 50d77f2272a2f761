"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` applies the operators to whole
tables and returns the digest columns their contracts name.

Task-side Python imports these modules, so on a cluster the package is shipped
with the job (``--py-files`` or an installed wheel), as any Spark job with
Python functions.
"""
