"""tessera: a PySpark-native engine for labelled multichannel time series and related table work."""
