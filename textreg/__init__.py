"""textreg: text analytics and regression on text, as Spark DataFrame operators."""
