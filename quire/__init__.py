"""quire: a PySpark-native engine for analysing collections of PDF documents."""
