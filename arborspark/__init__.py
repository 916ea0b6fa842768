"""Spark-native analytics over web pages: parse, select, extract, crawl."""
