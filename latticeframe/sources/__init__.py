"""Files of arrays: read by Spark as binary files, so any store that Spark reads will do."""
