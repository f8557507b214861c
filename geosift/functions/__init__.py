"""Column functions; none of them runs Python on the executors."""
