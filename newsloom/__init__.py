"""newsloom: a PySpark-native engine for news articles and the click behaviour around them."""
