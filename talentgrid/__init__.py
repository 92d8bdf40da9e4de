"""talentgrid: labour-market and skills analytics as Spark DataFrame operators."""
