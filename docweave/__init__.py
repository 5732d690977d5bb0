"""Natural joins over schema-free documents as Spark DataFrame jobs.

A *document* is a row ``(w, doc, m)``: the window it belongs to, its id, and a
``MAP<STRING,STRING>`` of attribute to value.  A *pair* is one map entry, in long
form ``(w, doc, attr, val)``.  Two documents of one window join when they share at
least one pair and carry no attribute with different values.
"""
