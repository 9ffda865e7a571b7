"""Column functions and the array functions behind them."""
