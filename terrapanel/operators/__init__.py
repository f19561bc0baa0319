"""Table operators: functions of DataFrames that return DataFrames."""
