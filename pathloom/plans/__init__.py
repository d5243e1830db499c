"""From text to a plan: syntax trees, types, values, and the compiler to Spark columns."""
