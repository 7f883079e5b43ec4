"""A Spark-native analytics engine for multichannel recordings and the dynamic graphs they give."""
