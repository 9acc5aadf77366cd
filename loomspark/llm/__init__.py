"""Training-data operators: thirteen corpus operations as Spark jobs.

Nothing outside this subpackage imports it; the registered queries live in
:mod:`loomspark.llm.queries` and the SQL they are held against in
:mod:`loomspark.llm.oracles`.
"""
