"""Fund-quote analytics as Spark jobs over long panels."""
