"""Operations of a training-data pipeline over ``documents`` and ``pages``.

Nothing outside this package imports it (``__spark_entry__.py`` adds its
queries only if it is there). One module per operator; ``queries.py`` registers
the ``opN_*`` queries, which derive their digest columns from the operators'
own outputs.
"""
