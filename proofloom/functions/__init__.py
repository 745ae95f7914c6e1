"""proofloom.functions"""
