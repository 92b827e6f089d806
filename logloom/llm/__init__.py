"""Operations of a training-data pipeline over document, benchmark and conversation tables.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries.
"""
