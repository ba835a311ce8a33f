"""docloom: a document analytics engine written as Spark DataFrame plans."""
