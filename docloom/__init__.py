"""docloom: document question-answering data jobs, written as PySpark DataFrame pipelines."""
