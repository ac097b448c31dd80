"""Training-data operators: one module per operator, nothing else imports this subpackage.

``kernels`` holds the numpy text kernels, ``durable`` the written tables that cut lineage,
``linkage`` the shared connected-group machinery, and ``queries`` what the driver runs.
"""
